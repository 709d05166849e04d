"""Queries of retrieval, context and guards. Benchmark items are the queries, documents the corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from ..functions import text, vectors
from ..operators import chunking, context, guard, lexical, retrieval
from ..plans import answer as plan
from .common import TOKENS, table

QUERIES, ORACLES = {}, {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, sf, k, match_all=False):
    return lexical.bm25_scan(_queries(spark, sf), _docs(spark, sf), k, match_all=match_all)


BM25 = f"""toks AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), post AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks),
tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM post GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
q AS (SELECT item_id AS query_id, list_distinct({TOKENS.format('text')}) AS t FROM benchmark), qt AS (SELECT query_id, len(t) AS n_terms, unnest(t) AS term FROM q),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
hit AS (SELECT query_id, doc_id, n_terms, count(*) AS matched, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id, n_terms),
bm AS (SELECT query_id, doc_id, score, matched, n_terms, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit)"""


@register(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 50")
def top_bm25(spark, sf):
    return _bm25(spark, sf, 50)


@register(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 20")
def top_bm25_index(spark, sf):
    d = _docs(spark, sf)
    return lexical.bm25(_queries(spark, sf), lexical.postings(d), lexical.corpus_stats(d), 20)


@register(f"WITH {BM25}, b AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit WHERE matched = n_terms) SELECT * FROM b WHERE rank <= 50")
def join_all_terms(spark, sf):
    return _bm25(spark, sf, 50, True)


DENSE = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings),
s AS (SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(a, b), 6) AS score FROM q, v), dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)"""


def _query_vectors(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@register(f"WITH {DENSE} SELECT query_id, item_id, score, rank FROM dense WHERE rank <= 10")
def top_dense(spark, sf):
    return vectors.top_k(_query_vectors(spark, sf), table(spark, sf, "embeddings"), 10)


@register("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def vec_cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("cos"))


@register("""WITH h AS (SELECT unnest(embedding)::DOUBLE AS x FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT (SELECT greatest(1, floor(count(*) * 0.01)::BIGINT) FROM embeddings))),
c AS (SELECT CASE WHEN max(x) - min(x) < 1e-8 THEN 1.0 ELSE max(x) - min(x) END / 254 AS s, min(x) AS lo FROM h), z AS (SELECT s, -lo / s AS z FROM c),
q AS (SELECT vec_id, s, z, list_transform(embedding::DOUBLE[], lambda x: greatest(0, least(255, round_even(x / s + z, 0)))) AS q FROM embeddings, z)
SELECT vec_id, array_to_string(list_transform(q, lambda x: x::INT), ',') AS quantized, round(list_sum(list_transform(q, lambda x: (x - z) * s)), 4) AS restored FROM q""")
def vec_quantize(spark, sf):
    e = table(spark, sf, "embeddings")
    c = F.broadcast(vectors.calibrate(e))  # one row
    q = e.crossJoin(c).withColumn("q", vectors.quantize(F.col("embedding"), F.col("scale"), F.col("zero_point")))
    total = F.aggregate(vectors.dequantize(F.col("q"), F.col("scale"), F.col("zero_point")), F.lit(0.0), lambda a, x: a + x)
    return q.select("vec_id", F.array_join("q", ",").alias("quantized"), F.round(total, 4).alias("restored"))


LEX = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"
LEXICAL = f"""c AS (SELECT b.query_id, b.doc_id, b.rank, i.text AS query, d.text FROM bm b JOIN benchmark i ON i.item_id = b.query_id JOIN documents d USING (doc_id) WHERE b.rank <= 50),
l AS (SELECT *, {LEX.format('query')} AS q, {LEX.format('text')} AS t FROM c),
ls AS (SELECT query_id, doc_id, rank, query, text, round(CASE WHEN len(q) > 0 AND len(t) > 0 THEN len(list_filter(q, lambda w: list_contains(t, w))) / len(q) + len(list_filter(q, lambda w: list_contains(t, w))) / len(t) + CASE WHEN contains(lower(text), lower(query)) THEN 0.2 ELSE 0 END ELSE 0 END, 6) AS rerank_score FROM l),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, doc_id) AS new_rank FROM ls)"""


def _candidates(spark, sf, k=50):
    c = _bm25(spark, sf, k).join(_docs(spark, sf), "doc_id").join(_queries(spark, sf).withColumnRenamed("text", "query"), "query_id")
    return c


@register(f"WITH {BM25}, {LEXICAL} SELECT query_id, doc_id, rerank_score, new_rank FROM rr WHERE new_rank <= 8")
def top_rerank(spark, sf):
    return retrieval.rerank(_candidates(spark, sf)).select("query_id", "doc_id", "rerank_score", "new_rank")


@register(f"""WITH {BM25}, {LEXICAL}, lists AS (SELECT query_id, doc_id, 0.4::DOUBLE / (60 + rank) AS part FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + new_rank) FROM rr),
f AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM lists GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT * FROM r WHERE rank <= 24""")
def join_fusion(spark, sf):
    c = _candidates(spark, sf)
    second = retrieval.rerank(c, 50).select("query_id", "doc_id", F.col("new_rank").alias("rank"))
    return retrieval.fuse({"bm25": c, "dense": second}, top_k=24)


@register(f"""WITH {BM25}, {LEXICAL}, lists AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, new_rank FROM rr), f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM lists GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT * FROM r WHERE rank <= 24""")
def join_variants(spark, sf):
    c = _candidates(spark, sf)
    both = c.select("query_id", "doc_id", "rank").unionByName(retrieval.rerank(c, 50).select("query_id", "doc_id", F.col("new_rank").alias("rank")))
    return retrieval.fuse_variants(both)


CODE = "'EQL' || lpad(p_partkey::VARCHAR, 5, '0') || 'D'"


@register(f"""WITH q AS (SELECT s_suppkey AS query_id, 'EQL' || lpad(s_suppkey::VARCHAR, 5, '0') || 'D' AS code FROM supplier), d AS (SELECT p_partkey AS doc_id, 'part {{0}} ' || lower({CODE}) || ' ' || p_name AS text FROM part)
SELECT query_id, doc_id, 2.0::DOUBLE AS score FROM q JOIN d ON contains(lower(text), lower(code))""".replace("{0}", ""))
def join_exact_codes(spark, sf):
    code = lambda c: F.concat(F.lit("EQL"), F.lpad(c.cast("string"), 5, "0"), F.lit("D"))
    q = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("rating of "), code(F.col("s_suppkey"))).alias("text"))
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("part  "), F.lower(code(F.col("p_partkey"))), F.lit(" "), "p_name").alias("text"))
    return lexical.exact_lookup(q, d)


@register("""WITH s AS (SELECT o_custkey AS query_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) AS rank FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
w AS (SELECT query_id, l_orderkey, rank, unnest(range(greatest(l_linenumber - 5, 0), l_linenumber + 6)) AS l_linenumber FROM s WHERE rank <= 5), m AS (SELECT query_id, l_orderkey, l_linenumber, min(rank) AS seed_rank FROM w GROUP BY ALL)
SELECT query_id, l_orderkey, l_linenumber::BIGINT AS l_linenumber, seed_rank::BIGINT AS seed_rank FROM m JOIN (SELECT l_orderkey, l_linenumber FROM lineitem) USING (l_orderkey, l_linenumber)""")
def join_neighbours(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    s = li.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("query_id")), "l_orderkey")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("l_orderkey", "l_linenumber")))
    out = context.neighbours(s, li, doc="l_orderkey", at="l_linenumber")
    return out.select("query_id", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("seed_rank").cast("long").alias("seed_rank"))


NORM = r"regexp_replace(regexp_replace(text, '\[Source:.*?\]\n?', '', 'g'), '^\s+|\s+$', '', 'g')"


@register(f"WITH d AS (SELECT 1 AS query_id, doc_id, row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) AS k FROM documents WHERE {NORM} <> '') SELECT query_id, doc_id FROM d WHERE k = 1")
def top_text_duplicates(spark, sf):
    d = _docs(spark, sf).withColumn("query_id", F.lit(1))
    return retrieval.text_duplicates(d, text.strip(text.without_citation(F.col("text"))), "doc_id").select("query_id", "doc_id")


ROWS = "(SELECT lang AS query_id, doc_id AS chunk_id, source, text, doc_id % 50 AS section, CASE WHEN doc_id % 5 > 0 THEN 's' || (doc_id % 5) END AS section_id, NULL AS section_title, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM documents)"


def _rows(spark, sf):
    d = table(spark, sf, "documents")
    sid = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")))
    return d.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"), "source", "text", (F.col("doc_id") % 50).alias("section"), sid.alias("section_id"), F.lit(None).cast("string").alias("section_title"), (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("score"))


def _sizes(spark, sf):
    """_rows with the length of each text instead of the text."""
    return _rows(spark, sf).withColumn("chars", F.length("text")).drop("text")


@register(f"""SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY source, section, chunk_id) AS document_order, row_number() OVER (PARTITION BY query_id ORDER BY section, source, chunk_id) AS section_order,
row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS relevance FROM {ROWS}""")
def top_orderings(spark, sf):
    out = _rows(spark, sf)
    for o in ("document_order", "section_order", "relevance"):
        out = context.ordered(out, o).withColumnRenamed("pos", o)
    return out.select("query_id", "chunk_id", "document_order", "section_order", "relevance")


@register(f"""WITH g AS (SELECT *, max(score) OVER (PARTITION BY query_id, section_id) AS best, row_number() OVER (PARTITION BY query_id, section_id ORDER BY section, chunk_id) AS k FROM {ROWS})
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY section_id IS NULL, best DESC, section_id, section, chunk_id) AS pos FROM g WHERE section_id IS NULL OR k <= 30""")
def top_by_section(spark, sf):
    return context.by_section(_rows(spark, sf)).select("query_id", "chunk_id", "pos")


@register(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM {ROWS}), t AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY pos) AS total FROM o) SELECT query_id, chunk_id, pos FROM t WHERE total <= 100000 OR pos = 1""")
def win_token_budget(spark, sf):
    return context.token_budget(context.ordered(_sizes(spark, sf))).select("query_id", "chunk_id", "pos")


@register(f"SELECT query_id, sum(length(text)) > 80000 AS map_reduce FROM {ROWS} GROUP BY query_id")
def agg_map_reduce(spark, sf):
    return context.map_reduce_needed(_rows(spark, sf))


@register(f"""WITH c AS (SELECT query_id, source, section AS page_num, '[Source: ' || source || ', Page ' || section || ']' AS citation, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM {ROWS}),
g AS (SELECT query_id, source, page_num, arg_min(citation, pos) AS citation, min(pos) AS first FROM c GROUP BY ALL) SELECT query_id, source, page_num, citation, row_number() OVER (PARTITION BY query_id ORDER BY first) AS n FROM g""")
def agg_sources(spark, sf):
    r = context.ordered(_rows(spark, sf)).withColumn("page_num", F.col("section")).withColumn("citation", text.citation(F.col("source"), F.col("section"), F.lit(None).cast("string")))
    return context.sources(r).select("query_id", "source", "page_num", "citation", "n")


@register(f"""WITH g AS (SELECT query_id, section_id, count(*) AS included, max(section) AS total FROM {ROWS} WHERE section_id IS NOT NULL GROUP BY ALL) SELECT query_id, section_id, included, total FROM g WHERE included < total""")
def agg_completeness(spark, sf):
    return context.completeness(_rows(spark, sf).withColumn("total_chunks_in_section", F.col("section"))).select("query_id", "section_id", "included", "total")


TOK_Q = TOKENS.format("i.text")


@register(f"""WITH {BM25}, a AS (SELECT item_id AS query_id, text, {TOKENS.format('text')} AS qt FROM benchmark), asked AS (SELECT query_id, unnest(qt) AS term FROM a), held AS (SELECT DISTINCT query_id, unnest(t) AS term FROM bm JOIN toks USING (doc_id) WHERE rank <= 8),
h AS (SELECT query_id, count(*) AS hits FROM asked JOIN held USING (query_id, term) GROUP BY 1), x AS (SELECT a.query_id, a.text, CASE WHEN f.query_id IS NOT NULL AND len(qt) > 0 THEN coalesce(hits, 0) / len(qt) ELSE 0 END AS kw, f.query_id IS NOT NULL AND len(qt) > 0 AS ok
 FROM a LEFT JOIN h USING (query_id) LEFT JOIN (SELECT DISTINCT query_id FROM bm) f USING (query_id))
SELECT query_id, round_even(kw, 4) AS keyword_overlap, round_even(kw * 0.4, 4) AS score, ok AND kw * 0.4 >= CASE WHEN len(regexp_split_to_array(lower(text), '\\s+')) <= 3 OR len(list_intersect(regexp_split_to_array(lower(text), '\\s+'), ['what', 'how', 'why', 'when', 'where', 'which', 'who', 'tell', 'explain', 'describe', 'show'])) > 0 THEN 0.05 ELSE 0.15 END AS is_grounded FROM x""".replace("\\\\", "\\"))
def agg_grounding(spark, sf):
    return guard.grounding(_queries(spark, sf), _candidates(spark, sf, 8).select("query_id", "rank", "text")).select("query_id", "keyword_overlap", "score", "is_grounded")


@register()
def top_mmr(spark, sf):
    e = table(spark, sf, "embeddings")
    t = vectors.top_k(_query_vectors(spark, sf), e, 100)
    c = t.join(e.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id").join(_query_vectors(spark, sf).withColumnRenamed("embedding", "q"), "query_id")
    return retrieval.mmr(c.withColumnRenamed("item_id", "doc_id"))


@register()
def top_near_duplicates(spark, sf):
    c = _candidates(spark, sf)
    return retrieval.near_duplicates(c)


@register()
def vec_hashing_embedder(spark, sf):
    e = table(spark, sf, "documents").select("doc_id", vectors.hashing_embedder()(F.col("text")).alias("e"))
    return e.select("doc_id", F.round(vectors.dot(F.col("e"), F.col("e")), 6).alias("norm"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register()
def plan_answer(spark, sf):
    """Every benchmark item asked of all documents."""
    d = _docs(spark, sf)
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text", "source", F.lit(1).alias("page_num"), F.lit(0).alias("section"), F.lit(None).cast("string").alias("section_title"))
    return plan.answer(_queries(spark, sf), chunks).select("query_id", "query_type", "route", "answer", "grounding", "is_grounded", "confidence")


def flagship(spark, sf):
    """For each user turn: the best chunks of all documents by BM25 and coverage, fused, compressed and labelled, with the grounding score."""
    from .common import user_turns

    q = user_turns(spark, sf)
    c = chunking.chunks(_docs(spark, sf)).withColumn("chunk_id", F.xxhash64("doc_id", "child_idx"))
    found = plan.retrieve(q, c, 10)
    best = found.join(c, "chunk_id")
    g = guard.grounding(q, best.select("query_id", "rank", "text"))
    label = text.citation(F.col("doc_id").cast("string"), F.lit(1), F.lit(None).cast("string"))
    return best.join(g.select("query_id", F.col("score").alias("grounding")), "query_id").select("query_id", "rank", "doc_id", "child_idx", "score", label.alias("citation"), text.compress(F.col("text")).alias("text"), "grounding")


QUERIES["flagship"] = flagship

