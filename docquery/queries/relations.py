"""Queries of stores, jobs, statistics, tables and sections over the relational tables and small fixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import canonical, chunking, guard, jobs, lexical, sections, stats, store, tables
from ..operators import retrieval
from .common import STATUS_SQL, jobs_of, table

QUERIES, ORACLES = {}, {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


JOBS = f"(SELECT event_id::VARCHAR AS job_id, event_id, user_id::VARCHAR AS tenant_id, '/in/' || event_id AS source_path, {STATUS_SQL} AS status, ts AS created_at, ts AS updated_at, value FROM events)"
NOW_SQL = "TIMESTAMP '2030-01-01 00:00:00'"


def _now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp")


@register("SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, count(DISTINCT lang) AS file_types FROM documents")
def agg_corpus(spark, sf):
    return stats.corpus(table(spark, sf, "documents"), kind="lang")


@register("SELECT lang AS file_type, count(DISTINCT doc_id) AS doc_count, count(*) AS chunk_count FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY chunk_count DESC, file_type")
def agg_by_type(spark, sf):
    return stats.by_type(table(spark, sf, "documents"), kind="lang")


@register(f"SELECT count(*) AS active FROM {JOBS} WHERE status IN ('queued', 'running', 'retry')")
def agg_active_jobs(spark, sf):
    return jobs.active(jobs_of(spark, sf))


@register("SELECT user_id, coalesce(strftime(max(ts), '%Y-%m-%d %H:%M:%S'), 'empty') AS corpus_version FROM events GROUP BY user_id")
def agg_corpus_version(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.coalesce(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit("empty")).alias("corpus_version"))


@register("WITH b AS (SELECT unnest([" + ", ".join(map(str, stats.BUCKETS)) + "])::DOUBLE AS le) SELECT event_type, le, count(*) FILTER (value <= le) AS n, count(*) AS total FROM events, b GROUP BY ALL")
def agg_histogram(spark, sf):
    return stats.histogram(table(spark, sf, "events"), "value", "event_type").select("event_type", "le", "n", "total")


@register("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS chunk_index_in_section, count(*) OVER (PARTITION BY lang) AS total_chunks_in_section FROM documents")
def agg_section_counts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("section_id"), F.col("doc_id").alias("chunk_id"))
    c = sections.with_counts(d)
    return c.select(F.col("section_id").alias("lang"), F.col("chunk_id").alias("doc_id"), F.col("chunk_index_in_section").cast("long").alias("chunk_index_in_section"), "total_chunks_in_section")


@register("WITH p AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) SELECT source, left(string_agg(text, chr(10) ORDER BY rn), 3000) AS intro FROM p WHERE rn <= 3 GROUP BY source")
def agg_intro(spark, sf):
    p = table(spark, sf, "documents").select("source", F.col("doc_id").alias("page_num"), "text")
    return chunking.summary_intro(p, "source")


@register(f"SELECT job_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, job_id) AS position FROM {JOBS} WHERE status IN ('queued', 'retry')")
def str_queue(spark, sf):
    return jobs.queue_position(jobs_of(spark, sf)).select("job_id", "tenant_id", F.col("position").cast("long").alias("position"))


@register(f"SELECT job_id FROM {JOBS} WHERE status IN ('queued', 'retry') ORDER BY created_at, job_id LIMIT 1")
def str_claim(spark, sf):
    return jobs.claim(jobs_of(spark, sf))


@register(f"SELECT job_id, CASE WHEN status = 'running' AND updated_at < {NOW_SQL} - INTERVAL 1800 SECOND THEN 'queued' ELSE status END AS status FROM {JOBS}")
def str_requeue(spark, sf):
    return jobs.requeued(jobs_of(spark, sf), _now()).select("job_id", "status")


@register(f"SELECT tenant_id, arg_max(status, event_id) AS status FROM {JOBS} GROUP BY tenant_id")
def str_latest(spark, sf):
    log = jobs_of(spark, sf).select("tenant_id", "status", "event_id")
    return jobs.latest(log, "tenant_id", "event_id").select("tenant_id", "status")


@register(f"SELECT job_id, CASE WHEN value > 50 THEN 'failed' ELSE status END AS status, CASE WHEN value > 50 THEN left('value ' || job_id, 4000) END AS error FROM {JOBS}")
def str_failed(spark, sf):
    j = jobs_of(spark, sf).withColumn("error", F.lit(None).cast("string"))
    bad = j.where("value > 50").select("job_id", F.concat(F.lit("value "), "job_id").alias("error"))
    return jobs.failed(j, bad, _now()).select("job_id", "status", "error")


@register(f"SELECT job_id, created_at::VARCHAR AS created_at FROM {JOBS} WHERE tenant_id = '1' ORDER BY created_at DESC, job_id LIMIT 50")
def top_jobs(spark, sf):
    return jobs.listed(jobs_of(spark, sf), "1").select("job_id", F.regexp_replace(F.col("created_at").cast("string"), r"\.0+$", "").alias("created_at"))


@register("WITH c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_type, event_id FROM c WHERE k <= 1000")
def win_cache_trim(spark, sf):
    return guard.trim(table(spark, sf, "events"), ["event_type"], order="ts", tie="event_id").select("event_type", "event_id")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_new_chunks(spark, sf):
    return store.new_only(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@register(f"SELECT '/in/' || o_orderkey AS path FROM orders WHERE '/in/' || o_orderkey NOT IN (SELECT source_path FROM {JOBS} WHERE status IN ('queued', 'running', 'retry')) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def join_to_ingest(spark, sf):
    paths = table(spark, sf, "orders").select(F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string")).alias("path"))
    done = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("/in/"), F.col("l_orderkey").cast("string")).alias("path"))
    return store.to_ingest(paths, done, jobs_of(spark, sf))


@register("SELECT doc_id, source FROM documents WHERE lang <> 'de'")
def snk_delete_sources(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("tenant_id"))
    return store.without_sources(d, d.where("tenant_id = 'de'")).select("doc_id", "source")


@register("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS version FROM documents")
def snk_replace(spark, sf):
    old = table(spark, sf, "documents").select("doc_id", F.lit("old").alias("version"))
    ids = table(spark, sf, "labels").select("doc_id").distinct().join(old.select("doc_id"), "doc_id", "left_semi")
    return store.replaced(old, ids.withColumn("version", F.lit("new")), ["doc_id"])


PART = "(SELECT 'doc' || (p_partkey % 7) AS doc_id, 't' || (p_partkey % 3) AS table_id, p_partkey AS row_index, p_name, p_retailprice, p_size FROM part)"


def _part_rows(spark, sf):
    p = table(spark, sf, "part")
    cells = F.create_map(F.lit("Name"), "p_name", F.lit("Price"), F.concat(F.col("p_size").cast("string"), F.lit(" mm")), F.lit("Catalogue Number"), F.concat(F.lit("EQL"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("D")))
    return p.select(F.concat(F.lit("doc"), F.col("p_partkey") % 7).alias("doc_id"), F.concat(F.lit("t"), F.col("p_partkey") % 3).alias("table_id"), F.col("p_partkey").alias("row_index"), "p_size", cells.alias("cells"))


@register(f"SELECT row_index, substr(sha256(doc_id || '::' || table_id || '::' || row_index), 1, 16) AS row_id FROM {PART}")
def prj_row_id(spark, sf):
    return _part_rows(spark, sf).select("row_index", canonical.row_id(F.col("doc_id"), F.col("table_id"), F.col("row_index")).alias("row_id"))


@register(f"SELECT row_index, p_size::DOUBLE AS price, p_size::DOUBLE AS mm FROM {PART}")
def prj_numeric_cells(spark, sf):
    n = _part_rows(spark, sf).select("row_index", canonical.numbers(F.col("cells")).alias("n"))
    return n.select("row_index", F.col("n")["Price"].alias("price"), F.col("n")["mm"].alias("mm"))


@register(f"SELECT row_index, '[' || table_id || ']; Name: ' || p_name || '; Price: ' || p_size || ' mm; Catalogue Number: EQL' || lpad(row_index::VARCHAR, 5, '0') || 'D' AS text FROM {PART}")
def prj_entry_text(spark, sf):
    return _part_rows(spark, sf).select("row_index", canonical.entry_text(F.col("table_id"), F.col("cells")).alias("text"))


@register(f"SELECT table_id, row_index FROM {PART} WHERE p_size > 20 AND p_size <= 40 ORDER BY table_id, row_index LIMIT 100")
def agg_canonical(spark, sf):
    s = _part_rows(spark, sf).select(F.col("table_id").alias("section_title"), "row_index", F.col("row_index").alias("row_id"), canonical.numbers(F.col("cells")).alias("numeric_cells"))
    return canonical.aggregate(s, [("mm", ">", 20), ("mm", "<=", 40)]).select(F.col("section_title").alias("table_id"), "row_index")


@register(f"SELECT row_index FROM {PART} WHERE p_size > 20")
def join_numeric_filter(spark, sf):
    s = _part_rows(spark, sf).select("row_index", canonical.numbers(F.col("cells")).alias("n"))
    return s.where(canonical.passes(F.col("n"), "price", ">", 20)).select("row_index")


@register("SELECT p_partkey AS row_id, CASE WHEN p_size > 25 THEN 'new' ELSE 'old' END AS nl_sentence, 'old' AS header_path FROM part WHERE p_size <= 40 UNION ALL SELECT p_partkey, 'new', 'new' FROM part WHERE p_size > 40")
def snk_upsert(spark, sf):
    p = table(spark, sf, "part")
    row = lambda v: [F.col("p_partkey").alias("row_id"), F.lit(v).alias("nl_sentence"), F.lit(v).alias("header_path")]
    return canonical.upsert(p.where("p_size <= 40").select(*row("old")), p.where("p_size > 25").select(*row("new")))


@register(f"SELECT s_suppkey AS query_id, s_suppkey AS row_index, 2.0::DOUBLE AS score FROM supplier JOIN part ON p_partkey = s_suppkey")
def join_canonical_lookup(spark, sf):
    q = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("size of EQL"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit("D")).alias("text"))
    # lpad cuts numbers of more than five digits, so that several parts have one code; the SQL joins by the number
    number = F.col("row_index").cast("string")
    code = F.concat(F.lit("EQL"), F.when(F.length(number) > 5, number).otherwise(F.lpad(number, 5, "0")), F.lit("D"))
    s = _part_rows(spark, sf).withColumn("row_id", number).withColumn("nl_sentence", F.col("cells")["Name"])
    s = s.withColumn("cells", F.map_concat(F.map_filter("cells", lambda k, _: k != "Catalogue Number"), F.create_map(F.lit("Catalogue Number"), code)))
    return canonical.lookup(q, s).where("score = 2").select("query_id", "row_index", "score")


COMPARED = "(VALUES ('a', 'H', '12'), ('a', 'W', '7'), ('b', 'H', '13'), ('b', 'Amps', '200')) v(item, field, value)"


@register(f"WITH v AS (SELECT * FROM {COMPARED}), g AS (SELECT DISTINCT f.field, i.item FROM v f, v i) SELECT field, item, coalesce(value, '—') AS value FROM g LEFT JOIN v USING (field, item)")
def join_comparison(spark, sf):
    items = spark.createDataFrame([("a", {"H": "12", "W": "7"}), ("b", {"H": "13", "Amps": "200"})], "item string, cells map<string,string>")
    return canonical.comparison(items, "item")


TREE = "(SELECT 'r' || r_regionkey AS section_id, NULL AS parent_id, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation)"


def _tree(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("section_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    return r.unionByName(table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("section_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title")))


@register(f"WITH RECURSIVE s AS (SELECT * FROM {TREE}), t AS (SELECT section_id AS root_id, section_id, 0 AS depth FROM s UNION ALL SELECT t.root_id, s.section_id, t.depth + 1 FROM t JOIN s ON s.parent_id = t.section_id) SELECT * FROM t")
def join_descendants(spark, sf):
    return sections.descendants(_tree(spark, sf))


@register(f"WITH s AS (SELECT * FROM {TREE}) SELECT a.section_id, coalesce(b.title || ' > ', '') || a.title AS path FROM s a LEFT JOIN s b ON b.section_id = a.parent_id")
def prj_heading_path(spark, sf):
    return sections.paths(_tree(spark, sf)).select("section_id", F.array_join("heading_path", " > ").alias("path"))


@register("""WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS section_id, o_orderkey % 5 AS level, o_orderkey % 20 AS a, o_orderkey % 20 + o_orderkey % 4 AS b FROM orders), c AS (SELECT c_custkey AS doc_id, unnest(range(0, 24)) AS page_num FROM customer),
j AS (SELECT doc_id, page_num, section_id, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY level DESC, section_id) AS k FROM c JOIN s USING (doc_id) WHERE page_num BETWEEN a AND b)
SELECT doc_id, page_num, section_id FROM c LEFT JOIN (SELECT * FROM j WHERE k = 1) USING (doc_id, page_num)""")
def join_page_section(spark, sf):
    k = F.col("o_orderkey")
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("section_id"), k.alias("ord"), (k % 5).alias("level"), F.array().cast("array<string>").alias("heading_path"), (k % 20).alias("page_start"), (k % 20 + k % 4).alias("page_end"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("page_num"))
    return sections.page_section(c, s).select("doc_id", "page_num", "section_id")


CELLS = "(SELECT l_orderkey AS table_id, l_linenumber AS row, CASE WHEN l_linenumber % 3 = 0 THEN 'A' || l_linenumber ELSE '' END AS text, 0 AS col FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'B' || l_linenumber END, 1 FROM lineitem)"


def _cells(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"))
    odd = F.col("row") % 3 == 0
    a = li.select("*", F.lit(0).alias("col"), F.when(odd, F.concat(F.lit("A"), F.col("row").cast("string"))).otherwise("").alias("text"))
    return a.unionByName(li.select("*", F.lit(1).alias("col"), F.when(odd, "").otherwise(F.concat(F.lit("B"), F.col("row").cast("string"))).alias("text"))).withColumn("is_header", F.lit(False))


@register(f"SELECT table_id, col, round(avg(CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0 END), 6) AS rate FROM {CELLS} GROUP BY ALL")
def agg_fill_rate(spark, sf):
    return tables.fill_rates(_cells(spark, sf)).select("table_id", "col", F.round("rate", 6).alias("rate"))


@register(f"""WITH r AS (SELECT *, avg(CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0 END) OVER (PARTITION BY table_id, col) AS rate, nullif(text, '') AS x FROM {CELLS}),
f AS (SELECT *, coalesce(x, last_value(x IGNORE NULLS) OVER (PARTITION BY table_id, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY table_id, col ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '') AS filled FROM r)
SELECT table_id, col, row, CASE WHEN rate <= 0.5 THEN filled ELSE text END AS text FROM f""")
def win_fill(spark, sf):
    return tables.fill(_cells(spark, sf)).select("table_id", "col", "row", "text")


@register("SELECT l_orderkey, l_linenumber, string_agg(l_quantity::INT::VARCHAR, '|') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM lineitem")
def win_adjacent_rows(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").rowsBetween(-1, 1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.collect_list(F.col("l_quantity").cast("int").cast("string")).over(w), "|").alias("near"))


@register("SELECT * FROM (VALUES (0, 'Number of Circuits'), (1, 'Catalogue Number'), (2, 'Slot Qty'), (3, 'Main Amps'), (4, 'Dimensions > H'), (5, 'Dimensions > W'), (6, 'Dimensions > D'), (7, 'Lug Data')) v(col, header)")
def win_nested_headers(spark, sf):
    top = ("Number of Circuits", "Catalogue Number", "Slot Qty", "Main Amps", "Dimensions", "", "", "Lug Data")
    low = ("", "", "", "", "H", "W", "D", "")
    c = spark.createDataFrame([("t", r, k, v, True) for r, line in enumerate((top, low)) for k, v in enumerate(line)], "table_id string, row int, col int, text string, is_header boolean")
    # an empty cell of the second row takes the one to its left only within the columns of one group; the last has none of its own
    return tables.header_paths(c.where("NOT (row = 1 AND col = 7)")).select("col", "header")


MARKDOWN = "| Model | Amps |\n|---|---|\n| A1 | 10 |\n| A2 | 20\nV |\n| A3 | 30 |\n| A4 | 40 |\n| A5 | 50 |\n| A6 | 60 |"


@register("SELECT * FROM (VALUES (0, 'Model: A1; Amps: 10.'), (1, 'Model: A2; Amps: 20 V.'), (2, 'Model: A3; Amps: 30.'), (3, 'Model: A4; Amps: 40.'), (4, 'Model: A5; Amps: 50.'), (5, 'Model: A6; Amps: 60.')) v(row, nl)")
def gen_row_chunks(spark, sf):
    t = spark.createDataFrame([("t", MARKDOWN)], "table_id string, markdown string")
    return tables.row_chunks(tables.markdown_cells(t)).select((F.col("row") - 1).alias("row"), "nl")


@register("SELECT * FROM (VALUES (0, 7), (1, 3)) v(chunk, lines)")
def gen_grouped_chunks(spark, sf):
    t = spark.createDataFrame([("t", MARKDOWN)], "table_id string, markdown string")
    return tables.grouped_chunks(tables.markdown_cells(t)).select("chunk", F.size(F.split("text", "\n")).alias("lines"))


@register("SELECT * FROM (VALUES ('a', 'a'), ('b', 'a'), ('c', 'c'), ('d', 'd')) v(table_id, stitched_id)")
def win_stitch(spark, sf):
    t = spark.createDataFrame([("x", 1, 0, "a", "", 2, ["H", "W"], False), ("x", 2, 0, "b", "", 2, ["H", "W"], False), ("x", 4, 0, "c", "", 2, ["H", "W"], False), ("x", 5, 0, "d", "", 2, ["K", "L"], False)], "doc_id string, page int, pos int, table_id string, title string, columns int, headers array<string>, first_row_text boolean")
    return tables.stitched(t).select("table_id", "stitched_id")


MANUAL = ((1, "# Drive\nA manual of the drive and its parts.\n## Wiring\nConnect L1."), (2, "and L2.\n1.1 Limits\n200 A at most.\nERROR CODES\nE1 means heat."), (3, "**Notes**\nKeep dry."))


@register("SELECT * FROM (VALUES (1, 'Drive', 1, 1, 'Drive'), (2, 'Wiring', 1, 2, 'Drive > Wiring'), (3, '1.1 Limits', 2, 2, 'Drive > 1.1 Limits'), (4, 'ERROR CODES', 2, 2, 'ERROR CODES'), (5, 'Notes', 3, 3, 'ERROR CODES > Notes')) v(ord, title, page_start, page_end, path)")
def gen_section_tree(spark, sf):
    p = spark.createDataFrame([("m", n, t) for n, t in MANUAL], "doc_id string, page_num int, text string")
    return sections.tree(p).select("ord", "title", "page_start", "page_end", F.array_join("heading_path", " > ").alias("path"))


@register("SELECT * FROM (VALUES (1, '[CSV DATA - Rows 1 to 3]' || chr(10) || '| k | v |' || chr(10) || '| a | 1 |' || chr(10) || '| a | 2 |' || chr(10) || '| b | 3 |')) v(page_num, text)")
def src_csv_pages(spark, sf):
    r = spark.createDataFrame([("f", 0, ["k", "v"]), ("f", 1, ["a", "1"]), ("f", 2, ["", " 2 "]), ("f", 3, ["", ""]), ("f", 4, ["b", "3"])], "file string, line int, cells array<string>")
    return chunking.csv_pages(r).select("page_num", "text")


@register("""WITH d AS (SELECT doc_id, source, text FROM documents), g AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, source FROM d),
c AS (SELECT source AS query_id, min(doc_id) AS doc_id FROM d GROUP BY source), s AS (SELECT c.query_id, d.doc_id, row_number() OVER (PARTITION BY c.query_id ORDER BY d.doc_id) AS rn FROM c JOIN d ON d.source = c.query_id)
SELECT query_id, doc_id, 1.0::DOUBLE AS score FROM c UNION ALL SELECT query_id, doc_id, 0.01::DOUBLE FROM s WHERE rn <= 200 AND (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM c)""")
def join_siblings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("table_group"))
    c = d.groupBy(F.col("table_group").alias("query_id")).agg(F.min("doc_id").alias("doc_id")).withColumn("score", F.lit(1.0))
    return retrieval.with_siblings(c, d)


_WORDS = "(list_filter(regexp_extract_all(lower(n_name), '[a-zA-Z0-9]+'), lambda t: length(t) > 2))[1:3]"


@register(f"""WITH q AS (SELECT c_custkey AS query_id, {_WORDS} AS words FROM customer JOIN nation ON n_nationkey = c_nationkey), t AS (SELECT DISTINCT n_name AS title, n_regionkey AS level FROM nation),
h AS (SELECT query_id, level, title, lower(title) LIKE '%' || array_to_string(words, '%') || '%' AS ordered FROM q JOIN t ON len(list_filter(words, lambda w: contains(lower(title), w))) > 0),
k AS (SELECT *, bool_or(ordered) OVER (PARTITION BY query_id) AS any_ordered FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level, title) AS rank FROM k WHERE ordered OR NOT any_ordered)
SELECT query_id, title, level FROM r WHERE rank <= 12""")
def join_section_expansion(spark, sf):
    q = table(spark, sf, "customer").join(table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select(F.col("c_custkey").alias("query_id"), F.col("n_name").alias("text"))
    s = table(spark, sf, "nation").select(F.col("n_name").alias("title"), F.col("n_regionkey").alias("level"), F.lit("").alias("heading_path"))
    return lexical.section_expansion(q, s).select("query_id", "title", "level")


@register("SELECT DISTINCT lang AS tenant_id, source FROM documents")
def set_distinct_sources(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("tenant_id"), text.basename(F.col("source")).alias("source")).distinct()
