"""Queries of the text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content, query, text
from ..operators import chunking
from .common import TOKENS, TURNS, sql_list, table, user_turns

QUERIES, ORACLES = {}, {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


S = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@register("SELECT doc_id, sha256('[' || source || ', Page 1]' || chr(10) || text) AS chunk_hash FROM documents")
def prj_contextual_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.lit(1).alias("page_num"), "text")
    return chunking.contextual(d).select("doc_id", "chunk_hash")


@register("""SELECT doc_id, CASE WHEN length(text) > 3500 AND NOT (contains(text, '[TABLE') OR contains(text, '| ')) THEN
  CASE WHEN contains(left(text, 3500), ' ') AND 3500 - strpos(reverse(left(text, 3500)), ' ') > 1750 THEN left(text, 3500 - strpos(reverse(left(text, 3500)), ' ')) ELSE left(text, 3500) END || '...' ELSE text END AS text FROM documents""")
def prj_compress(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.compress(F.col("text")).alias("text"))


@register("""SELECT doc_id, '[Source: ' || source || ', Page ' || (doc_id % 7) || ', Section: ' || lang || ']' || chr(10) || text AS text FROM documents""")
def prj_citation(spark, sf):
    d = table(spark, sf, "documents")
    label = text.citation(F.concat(F.lit("/data/"), "source"), F.col("doc_id") % 7, F.col("lang"))
    return d.select("doc_id", text.with_citation(label, F.col("text")).alias("text"))


@register(r"SELECT doc_id, regexp_replace('[' || source || ', Page 3]' || chr(10) || text, '\[.*?(?:Page|Part)\s*\d+\]\s*', '', 'g') AS text FROM documents")
def prj_header_strip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.without_headers(F.concat(text.page_header(F.col("source"), F.lit(3)), "text")).alias("text"))


@register("SELECT doc_id, '[' || source || ', Page 1]' || chr(10) || left(text, 4000) || CASE WHEN length(text) > 4000 THEN '...' ELSE '' END AS answer FROM documents")
def prj_extractive(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.extractive_answer(F.col("source"), F.lit(1), F.col("text")).alias("answer"))


@register(f"""WITH d AS (SELECT doc_id, text, CASE WHEN length(text) <= 600 THEN 1 ELSE ceil((length(text) - 600) / 450.0)::INT + 1 END AS n FROM documents),
w AS (SELECT doc_id, k, {S.format('substr(text, k * 450 + 1, 600)')} AS text FROM (SELECT *, unnest(range(n)) AS k FROM d))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS child_idx, text FROM w WHERE text <> ''""")
def gen_child_windows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.windows(F.col("text"))).alias("child_idx", "text")).select("doc_id", F.col("child_idx").cast("long").alias("child_idx"), "text")


@register(rf"""WITH RECURSIVE p AS (SELECT doc_id, {S.format('text')} AS b FROM documents WHERE length({S.format('text')}) > 10),
s AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(b, '. '), lambda x: {S.format('x')}), lambda x: x <> ''), lambda x: x || '.') AS parts FROM p WHERE length(b) > 2400),
f AS (SELECT doc_id, parts, 1 AS i, 0 AS g, 0 AS len, 0 AS put FROM s UNION ALL
  SELECT doc_id, parts, i + 1, CASE WHEN put > 0 AND len + length(parts[i]) > 2400 THEN g + 1 ELSE g END, CASE WHEN put > 0 AND len + length(parts[i]) > 2400 THEN length(parts[i]) + 1 ELSE len + length(parts[i]) + 1 END, 1 FROM f WHERE i <= len(parts)),
packed AS (SELECT doc_id, g AS parent_idx, string_agg(parts[i - 1], ' ' ORDER BY i) AS parent FROM f WHERE i > 1 GROUP BY doc_id, g),
parents AS (SELECT doc_id, 0 AS parent_idx, b AS parent FROM p WHERE length(b) <= 2400 UNION ALL SELECT * FROM packed),
w AS (SELECT doc_id, parent_idx, parent, unnest(range(CASE WHEN length(parent) <= 600 THEN 1 ELSE ceil((length(parent) - 600) / 450.0)::INT + 1 END)) AS k FROM parents),
c AS (SELECT doc_id, parent_idx, k, {S.format('substr(parent, k * 450 + 1, 600)')} AS text FROM w)
SELECT doc_id, parent_idx::BIGINT AS parent_idx, row_number() OVER (PARTITION BY doc_id ORDER BY parent_idx, k) - 1 AS child_idx, text FROM c WHERE text <> ''""")
def gen_chunks(spark, sf):
    c = chunking.chunks(table(spark, sf, "documents").select("doc_id", "text"))
    return c.select("doc_id", F.col("parent_idx").cast("long").alias("parent_idx"), F.col("child_idx").cast("long").alias("child_idx"), "text")


@register(f"WITH d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct, sha256(array_to_string(t, ' ')) AS digest FROM d")
def fn_tokens(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


def _types(c: str) -> str:
    when = " ".join(f"WHEN regexp_matches(q, '(?i){'|'.join(p)}') THEN '{k}'" for k, p in query.TYPE_PATTERNS.items())
    return f"SELECT {c}, CASE WHEN length(q) < 3 THEN 'fact' {when} ELSE 'fact' END"


ASKED = (
    "Summarize chapter 3", "give me a summary", "difference between a relay and a contactor", "my sensor is not responding", "how to install the drive", "show the wiring table", "list parameter values",
    "explain everything about modbus", "what is a sensor", "hi", "What is a contactor and how does it differ from a relay?", "list all alarms and explain each of them", "torque spec in the welding manual",
    "installation steps on page 5", "wiring in section 3.2", "pages 10 to 15 of the electrical guide", "What is a DC sensor?", "compare EQL40200D and SNC2448L1125", "hello!", "give me all details of chapter 7 in the drive manual p. 9",
)
VALUES = "(SELECT * FROM (VALUES " + ", ".join(f"({k}, '{q}')" for k, q in enumerate(ASKED)) + ") v(query_id, text))"
EVERY = f"(SELECT query_id, text FROM {TURNS} UNION ALL SELECT -1 - query_id, text FROM {VALUES})"


def _asked(spark, sf):
    v = spark.createDataFrame([(-1 - k, q) for k, q in enumerate(ASKED)], "query_id long, text string")
    return user_turns(spark, sf).unionByName(v)


@register(f"{_types('query_id')} AS query_type FROM (SELECT query_id, {S.format('text')} AS q FROM {EVERY})")
def fn_query_type(spark, sf):
    return _asked(spark, sf).select("query_id", query.query_type(F.col("text")).alias("query_type"))


@register(f"""SELECT t.query_id, s.* EXCLUDE (query_type), t.query_type FROM ({_types('query_id')} AS query_type FROM (SELECT query_id, {S.format('text')} AS q FROM {EVERY})) t
JOIN (VALUES {', '.join("('" + s[0] + f"', {s[1]}, {s[8]}, '{s[9]}', '{s[10]}')" for s in query.STRATEGIES)}) s(query_type, top_k, max_section_chunks, context_ordering, prompt_style) ON s.query_type = t.query_type""")
def fn_strategy(spark, sf):
    q = _asked(spark, sf).select("query_id", query.query_type(F.col("text")).alias("query_type"))
    return q.join(query.strategies(spark), "query_type").select("query_id", "query_type", "top_k", "max_section_chunks", "context_ordering", "prompt_style")


@register(f"""WITH q AS (SELECT query_id, lower({S.format('text')}) AS low FROM {EVERY})
SELECT query_id, CASE WHEN regexp_matches(low, '{query.GREETING}') THEN 'greeting' WHEN regexp_matches(low, '{query.ANALYSIS}') THEN 'full'
 WHEN regexp_matches(low, '{query.SIMPLE}') OR len(list_filter(regexp_split_to_array(low, '\\s+'), lambda w: w <> '')) <= 5 THEN 'fast' ELSE 'full' END AS route FROM q""".replace("\\\\s", "\\s"))
def fn_route(spark, sf):
    return _asked(spark, sf).select("query_id", query.route(F.col("text")).alias("route"))


@register(rf"""SELECT query_id, list_bool_or(list_transform([{sql_list(query.BROAD)}], lambda p: contains(' ' || lower(text) || ' ', p))) AS broad,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{query.IDENTIFIER}'), lambda x: lower(x)))), ',') AS ids,
 array_to_string(regexp_extract_all(text, '{query.CATALOGUE}'), ',') AS codes FROM {EVERY}""")
def fn_query_features(spark, sf):
    t = F.col("text")
    return _asked(spark, sf).select("query_id", query.is_broad(t).alias("broad"), F.array_join(query.identifiers(t), ",").alias("ids"), F.array_join(query.catalogue_patterns(t), ",").alias("codes"))


def _signals() -> str:
    return " ".join(f"WHEN list_bool_or(list_transform([{sql_list(v)}], lambda p: contains(lower(text), p))) THEN '{k}'" for k, v in query.TABLE_SIGNALS.items())


@register(f"SELECT query_id, CASE {_signals()} WHEN regexp_matches(text, '{query.CATALOGUE}') THEN 'table_lookup' ELSE 'text' END AS query_type FROM {EVERY}")
def fn_table_query_type(spark, sf):
    return _asked(spark, sf).select("query_id", query.table_query_type(F.col("text")).alias("query_type"))


_KEY = f"list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({sql_list(query.TOPIC_STOP)}))"


@register(f"""WITH q AS (SELECT query_id, text, array_to_string(({_KEY})[1:3], ' ') AS head FROM {EVERY})
SELECT query_id, unnest(CASE WHEN head = '' THEN [text] ELSE list_concat([text], list_transform([{sql_list(query.ASPECTS)}], lambda a: head || ' ' || a)) END) AS variant FROM q""")
def fn_expand(spark, sf):
    return _asked(spark, sf).select("query_id", F.explode(query.expand(F.col("text"))).alias("variant"))


def _g(p: str, k: int) -> str:
    return S.format(f"regexp_extract(s, '{p}', {k})")


@register(rf"""WITH q AS (SELECT query_id, text, {S.format('text')} AS s FROM {EVERY}), x AS (SELECT *, {_g(query.COMPARATIVE, 1)} AS a, {_g(query.COMPARATIVE, 2)} AS b FROM q)
SELECT query_id, unnest(list_sort(list_distinct(CASE WHEN length(s) < 10 THEN [text] WHEN regexp_matches(s, '{query.COMPARATIVE}') THEN [s, 'What is ' || a || '?', 'What is ' || b || '?', 'What are the differences between ' || a || ' and ' || b || '?']
 WHEN regexp_matches(s, '{query.LIST_EXPLAIN}') THEN [s, {_g(query.LIST_EXPLAIN, 1)} || '?', {_g(query.LIST_EXPLAIN, 2)} || '?']
 WHEN regexp_matches(s, '{query.CONJUNCTIVE}') THEN [s, regexp_replace({_g(query.CONJUNCTIVE, 1)}, '\?+$', '') || '?', regexp_replace({_g(query.CONJUNCTIVE, 2)}, '\?+$', '') || '?'] ELSE [text] END))) AS part FROM x""")
def fn_decompose(spark, sf):
    return _asked(spark, sf).select("query_id", F.explode(query.decompose(F.col("text"))).alias("part"))


def _one(patterns, c="text") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{p}', 1), '')" for p in patterns) + ")"


@register(rf"""SELECT query_id, CASE WHEN regexp_matches(text, '{query.PAGE_RANGE}') THEN regexp_extract(text, '{query.PAGE_RANGE}', 1)::INT END AS page_from,
 CASE WHEN NOT regexp_matches(text, '{query.PAGE_RANGE}') THEN {_one(query.PAGE_PATTERNS)}::INT END AS page, {_one(query.SECTION_PATTERNS)} AS section FROM {EVERY}""")
def fn_filters(spark, sf):
    f = _asked(spark, sf).select("query_id", query.filters(F.col("text")).alias("f"))
    return f.select("query_id", "f.page_from", "f.page", "f.section")


@register("SELECT query_id, target_file FROM (VALUES (-13, 'welding'), (-16, 'electrical'), (-20, 'drive')) v(query_id, target_file)")
def fn_filter_files(spark, sf):
    v = spark.createDataFrame([(-1 - k, q) for k, q in enumerate(ASKED)], "query_id int, text string")
    return v.select("query_id", query.filters(F.col("text"))["target_file"].alias("target_file")).where("target_file IS NOT NULL")


@register(rf"SELECT doc_id, {S.format(chr(39).join(['regexp_extract(text, ', content.EQUATION, ', 0)']))} AS equation FROM documents WHERE regexp_matches(text, '{content.EQUATION}') AND length({S.format('text')}) <= 500")
def fn_equation(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", content.equation(F.col("text")).alias("f")).where("f IS NOT NULL")
    return d.select("doc_id", F.get_json_object("f.data", "$.equation").alias("equation"))


BLOCKS = (
    "1. Which unit is current?\nA) Volt\nB) Ampere ✓\nC) Ohm", "The unit of resistance is _____.\nAnswer: Ohm", "Copper conducts\nTrue ✓", "Rated current: 200 A\nRated voltage: 480 V", "Name: Pump 7\nPlace: Hall 3",
    "Contactor: A device that switches a power circuit", "P = U * I", "Pumps move water from one vessel to another.",
)


@register("SELECT * FROM (VALUES (0, 'mcq', 0.95::DOUBLE), (1, 'fill_blank', 0.9), (2, 'true_false', 0.85), (3, 'specification', 0.85), (4, 'form_field', 0.8), (5, 'definition', 0.8), (6, 'equation', 0.75), (7, 'paragraph', 0.5)) v(block, content_type, confidence)")
def fn_content_types(spark, sf):
    b = spark.createDataFrame(list(enumerate(BLOCKS)), "block int, text string").select("block", content.classify(F.col("text")).alias("f"))
    return b.select("block", "f.content_type", "f.confidence")


_TAGS = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', chr(10), 'g'), '(?is)<(script|style|nav|footer|header)\b.*?</(script|style|nav|footer|header)\s*>', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"


@register(f"""WITH t AS (SELECT page_id, replace(replace(replace(replace(replace(replace({_TAGS}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: {S.format('x')}), lambda x: x <> ''), chr(10)) AS text FROM t""")
def src_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@register(r"""SELECT page_id, regexp_replace(regexp_extract('[InternetShortcut] URL=' || url || '"]', 'https?://\S+'), '["\]<].*$', '') AS url FROM pages""")
def src_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.first_url(F.concat(F.lit("[InternetShortcut] URL="), "url", F.lit('"]'))).alias("url"))


FILES = ("a.PDF", "b/c.docx", "x.csv", "notes.md", "run.py", "m.eml", "s.url", "z.tar", "p.JPG", "v.mkv", "t.srt", "noext", ".hidden", "q.unknown", "d.tar.gz")


@register("SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{k}', {str(k != 'unknown').lower()})" for f, k in zip(FILES, ("pdf", "docx", "csv", "text", "code", "email", "url", "archive", "image", "video", "subtitle", "unknown", "unknown", "unknown", "archive"), strict=True)) + ") v(path, file_type, supported)")
def src_file_types(spark, sf):
    f = spark.createDataFrame([(f,) for f in FILES], "path string")
    return f.select("path", text.file_type(F.col("path")).alias("file_type"), text.is_supported(F.col("path")).alias("supported"))


SYMBOLS = (("EQL40200D³", "EQL40200D3"), ("13⁵⁄₁₆", "135/16"), ("see ①", "see  [Note 1]"), ("EQL40200D100A", "EQL40200D10 | 0A"), ("SNC2448L1125 1 Phase", "SNC2448L1125 | 1 Phase"), ("½ in ®", "1/2 in (R)"))


@register("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYMBOLS) + ") v(raw, text)")
def prj_symbols(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in SYMBOLS], "raw string").select("raw", text.normalize_symbols(F.col("raw")).alias("text"))


@register(rf"SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {S.format('x')}), lambda x: length(x) > 10)) AS sentence FROM documents")
def fn_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))


@register("""WITH w AS (SELECT d.doc_id, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(n.text), '\\s+'), lambda x: x <> '')) AS b
 FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS overlap FROM w""".replace("\\\\", "\\"))
def fn_overlap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.words(F.col("text")).alias("a"))
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(n, "doc_id").select("doc_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))
