"""Understanding of query texts: type, route, filters, parts, expansion. All Columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import strip

# What each type of query looks like, in the order of trial. The tables of this module are data.
TYPE_PATTERNS = {
    "chapter": (
        r"\b(?:summarize|explain|describe|give)\s+(?:the\s+)?(?:full\s+|entire\s+|complete\s+)?chapter\s+(\d+)",
        r"\bchapter\s+(\d+)\s+(?:summary|overview|content|details?)",
        r"\b(?:entire|whole|full|complete)\s+chapter\b",
    ),
    "summary": (
        r"\b(?:summarize|summary)\s+(?:the\s+)?(?:entire\s+|whole\s+|full\s+|complete\s+)?(?:document|manual|file|pdf|guide|book|report)\b",
        r"\b(?:overview|outline)\s+(?:of\s+)?(?:the\s+)?(?:entire\s+|whole\s+)?(?:document|manual|file|pdf)\b",
        r"\b(?:give|provide)\s+(?:me\s+)?(?:a\s+|an\s+)?(?:brief\s+|short\s+)?(?:summary|overview)\b",
    ),
    "comparison": (
        r"\b(?:difference|differ|compare|comparison|contrast|distinguish|versus|vs\.?)\b",
        r"\b(?:between)\s+.+\s+(?:and|&|vs\.?)\s+",
        r"\b(?:which\s+(?:one|is\s+better)|pros?\s+and\s+cons?|advantages?\s+(?:and|vs)\s+disadvantages?)\b",
    ),
    "troubleshoot": (
        r"\b(?:troubleshoot|diagnos(?:e|is|tic)|debug|fix|solve|resolv)\b",
        r"\bnot\s+(?:working|responding|connecting|communicating|functioning)\b",
        r"\b(?:error|fault|failure|problem|issue)\s+(?:with|in|when|during)\b",
        r"\b(?:complete|full)\s+troubleshoot(?:ing)?\b",
        r"\bwhat\s+(?:to\s+do|should\s+I\s+do)\s+(?:if|when)\b",
    ),
    "procedure": (
        r"\b(?:how\s+to|steps?\s+(?:to|for)|procedure\s+(?:to|for)|process\s+(?:to|for))\b",
        r"\b(?:install(?:ation)?|setup|configur(?:e|ation)|calibrat(?:e|ion)|assembl(?:e|y))\s+(?:guide|steps?|procedure|instructions?|process)\b",
        r"\b(?:step[\s-]by[\s-]step|instructions?\s+(?:for|to))\b",
    ),
    "table": (
        r"\b(?:show|display|find|where\s+is)\s+(?:the\s+)?(?:\w+\s+){0,3}table\b",
        r"\btable\s+(?:of|for|with|showing|listing)\b",
        r"\b(?:rating|specification|spec|wiring|pin(?:out)?|dimension)\s+table\b",
    ),
    "parameter": (
        r"\b(?:list|show|display|what\s+are)\s+(?:the\s+)?(?:all\s+)?(?:parameter|setting|register|config(?:uration)?|option|value|specification|spec)\b",
        r"\b(?:parameter|register|setting)\s+(?:list|table|value|range|default)\b",
        r"\b(?:all|every|each)\s+(?:parameter|register|setting|config(?:uration)?)\b",
    ),
    "topic": (
        r"\b(?:explain|describe)\s+(?:everything|all|complete|full|entire|detailed)\s+(?:about|details?\s+(?:of|about)?|info(?:rmation)?\s+(?:of|about|on)?)",
        r"\b(?:tell|give)\s+(?:me\s+)?(?:all|everything|complete|full|entire|detailed)\s+(?:about|details?\s+(?:of|about)?|info(?:rmation)?\s+(?:of|about|on)?)",
        r"\b(?:complete|full|detailed|entire)\s+(?:guide|explanation|description|info(?:rmation)?|details?)\s+(?:of|about|on|for)\b",
        r"\b(?:explain|describe|discuss)\s+(?:the\s+)?(?:\w+\s+){0,2}(?:communication|protocol|interface|system|module|feature|function|operation|process|mechanism)\b",
        r"\b(?:all|every)\s+(?:parameter|command|register|alarm|error|feature|setting|option|config(?:uration)?)\s+(?:of|for|about|related|in)\b",
        r"\b(?:explain|describe)\s+(?:the\s+)?(?:full|complete|entire)\b",
        r"\bwhat\s+(?:is|are)\s+(?:all|the\s+different|the\s+various)\b",
        r"\b(?:list|enumerate)\s+(?:all|every|each)\b",
    ),
}
# How each type of query is answered.
STRATEGY_FIELDS = "query_type string, top_k int, expand_section boolean, multi_query int, section_search boolean, chapter_retrieval boolean, map_reduce boolean, table_search boolean, max_section_chunks int, context_ordering string, prompt_style string"
STRATEGIES = (
    ("fact", 12, False, 0, False, False, False, False, 40, "relevance", "standard"),
    ("topic", 40, True, 6, True, False, False, False, 40, "section_order", "comprehensive"),
    ("chapter", 80, True, 0, False, True, False, False, 80, "document_order", "comprehensive"),
    ("summary", 60, True, 0, False, False, True, False, 100, "document_order", "comprehensive"),
    ("troubleshoot", 30, True, 4, True, False, False, False, 40, "section_order", "diagnostic"),
    ("procedure", 20, True, 0, True, False, False, False, 40, "document_order", "procedural"),
    ("comparison", 40, True, 4, True, False, False, False, 40, "relevance", "comparative"),
    ("parameter", 30, False, 4, False, False, False, True, 40, "section_order", "standard"),
    ("table", 20, False, 0, False, False, False, True, 40, "relevance", "standard"),
)
# Words that name a document, and prepositions before it.
_DOC = "manual|guide|document|specification|spec|datasheet"
_DOCS = _DOC + "|report|pdf|file|handbook|procedure|standard"
FILE_PATTERNS = (rf"(?i)(?:in|from|within|inside|of)\s+the\s+([a-z0-9\s\-_]+?)\s+(?:{_DOCS})", rf"(?i)the\s+([a-z0-9\s\-_]+?)\s+(?:{_DOCS})", rf"(?i)^([a-z0-9\s\-_]+?)\s+(?:{_DOC})")
REJECTED_FILES = ("the", "a", "an", "this", "that", "above", "following", "of", "by", "its")
PAGE_RANGE = r"(?i)\bpages?\s+(\d+)\s*(?:to|-|–|through)\s*(\d+)\b"
PAGE_PATTERNS = (r"(?i)\bon\s+page\s+(\d+)\b", r"(?i)\bpage\s+(\d+)\b", r"(?i)\bp\.\s*(\d+)\b")
SECTION_PATTERNS = (r"(?i)\b(?:in\s+)?section\s+(\d+(?:\.\d+)*)\b", r"(?i)\b(?:in\s+)?chapter\s+(\d+)\b", r"(?i)\bsec\.\s*(\d+(?:\.\d+)*)\b")
COMPARATIVE = r"(?i)(?:differences?\s+between|compare|contrast|distinguish)\s+(.+?)\s+and\s+(.+)"
LIST_EXPLAIN = r"(?i)^(list\s+.+?)\s+and\s+(explain\s+.+)$"
CONJUNCTIVE = r"(?i)^(.+?)\s+and\s+((?:how|what|why|where|when|which|who|explain|describe|list|tell)\s+.+)$"
CATALOGUE = r"\b[A-Z]{2,5}\d{2,6}[A-Z0-9\-]*\b"
IDENTIFIER = r"\b[a-zA-Z0-9]*[0-9][a-zA-Z0-9]*\b"
# Signals of the table engine's own query types, in the order of trial.
TABLE_SIGNALS = {
    "table_compare": ("compare", "difference between", " vs ", "versus", "better than", "which is larger", "which has more"),
    "table_aggregate": ("list all", "all models", "how many", "which models", "show all", "give me all", "every model", "all circuits"),
    "calculation": ("total", "sum", "average", "calculate", "how much does"),
    "table_lookup": ("catalogue number", "model number", "part number", "what is the", "dimensions of", "rating of", "door kit", "factory modification", "ordering data", "lug data", "mounting"),
}
# Phrases of broad queries, of analysis, of simple questions and of greetings.
BROAD = (" all ", " every ", " each ", " topics", " topic ", " complete", " full ", " final ", " summarize", " summary", " overview")
ANALYSIS = (
    r"(?:compare|contrast|difference|analysis|analyze|predict|trend|pattern|relationship|correlation|impact|effect|cause|explain|why\s+|how\s+(?:does|do|can|would|to|is|are)"
    r"|summarize|overview|troubleshoot|diagnos(?:e|is|tic)|list\s+all|\ball\s+the\b|\bevery\b|\beach\b)"
)
SIMPLE = r"(?:(?:^|\s)what\s+is|(?:^|\s)who\s+is|(?:^|\s)when\s+|(?:^|\s)where\s+|(?:^|\s)which\s+|(?:^|\s)how\s+to|(?:^|\s)define\s+|(?:^|\s)meaning\s+|(?:^|\s)list\s+|(?:^|\s)show\s+)"
GREETING = r"^(hi|hello|hey|greetings|how are you|good morning|good afternoon)(?:\s+|$|[!.,?])"
TOPIC_STOP = (
    "explain", "describe", "tell", "give", "show", "list", "what", "how", "all", "every", "each", "complete", "full", "entire", "detailed", "about", "information", "info",
    "details", "the", "a", "an", "is", "are", "was", "were", "me", "please", "everything", "related", "to", "of", "in", "on", "for", "with", "from", "and", "or", "that", "this",
)
ASPECTS = ("configuration", "installation setup", "commands", "troubleshooting errors", "parameters settings", "specifications limitations")
FLARE_STOP = (
    "this", "that", "with", "from", "have", "been", "will", "would", "could", "should", "their", "there", "which", "what", "when", "where", "how", "does", "based",
    "also", "used", "using", "such", "each", "than", "then", "very", "more", "most", "some", "just", "only",
)


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STRATEGIES), STRATEGY_FIELDS)


def query_type(q: Column) -> Column:
    """The first type one of whose patterns is found; fact otherwise."""
    out = F.lit("fact")
    for kind, patterns in reversed(TYPE_PATTERNS.items()):
        out = F.when(strip(q).rlike("(?i)" + "|".join(patterns)), kind).otherwise(out)
    return F.when(F.length(strip(q)) < 3, "fact").otherwise(F.coalesce(out, F.lit("fact")))


def table_query_type(q: Column) -> Column:
    out = F.when(q.rlike(CATALOGUE), "table_lookup").otherwise("text")
    for kind, signals in reversed(TABLE_SIGNALS.items()):
        out = F.when(F.exists(F.array(*map(F.lit, signals)), lambda s: F.lower(q).contains(s)), kind).otherwise(out)
    return out


def catalogue_patterns(q: Column) -> Column:
    return F.regexp_extract_all(q, F.lit(CATALOGUE), F.lit(0))


def identifiers(q: Column) -> Column:
    """Sorted distinct lower-case words that hold a digit."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(IDENTIFIER), F.lit(0)), F.lower)))


def is_broad(q: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(q), F.lit(" "))
    return F.exists(F.array(*map(F.lit, BROAD)), lambda s: padded.contains(s))


def word_count(q: Column) -> Column:
    return F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))


def retrieval_query(q: Column, parent: Column, child: Column) -> Column:
    """The query with the conversation's parent and child hints, where it is broad or short."""
    hinted = F.concat_ws(" ", q, F.nullif(strip(parent), F.lit("")), F.nullif(strip(child), F.lit("")))
    return F.when(is_broad(q) | (word_count(q) <= 5), hinted).otherwise(q)


def route(q: Column) -> Column:
    """greeting (answered at once), fast (retrieve and answer) or full."""
    low = F.lower(strip(q))
    simple = low.rlike(SIMPLE) | (word_count(low) <= 5)
    return F.when(low.rlike(GREETING), "greeting").when(low.rlike(ANALYSIS), "full").when(simple, "fast").otherwise("full")


def _first(q: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(q, p, 1), F.lit("")) for p in patterns])


def filters(q: Column) -> Column:
    """STRUCT<page_from, page_to, page, target_file, section> told by the query's words."""
    ranged = q.rlike(PAGE_RANGE)
    rest = F.when(ranged, F.regexp_replace(q, PAGE_RANGE + r"|^\s+", "")).otherwise(q)
    rest = F.regexp_replace(rest, r"\s{2,}", " ")
    names = []
    for p in FILE_PATTERNS:
        name = strip(F.lower(F.regexp_extract(rest, p, 1)))
        name = strip(F.regexp_replace(name, r"^(?:of |in |from )+", ""))
        names.append(F.when((F.length(name) > 2) & ~name.isin(*REJECTED_FILES), name))
    return F.struct(
        F.when(ranged, F.regexp_extract(q, PAGE_RANGE, 1).try_cast("int")).alias("page_from"), F.when(ranged, F.regexp_extract(q, PAGE_RANGE, 2).try_cast("int")).alias("page_to"),
        F.when(~ranged, _first(q, PAGE_PATTERNS)).try_cast("int").alias("page"), F.coalesce(*names).alias("target_file"), _first(q, SECTION_PATTERNS).alias("section"),
    )


def decompose(q: Column) -> Column:
    """The query and the questions that it is made of, in order, without repeats."""
    s = strip(q)
    x, y = strip(F.regexp_extract(s, COMPARATIVE, 1)), strip(F.regexp_extract(s, COMPARATIVE, 2))
    ask = lambda p, k: F.concat(F.regexp_replace(strip(F.regexp_extract(s, p, k)), r"\?+$", ""), F.lit("?"))
    plain = lambda p, k: F.concat(strip(F.regexp_extract(s, p, k)), F.lit("?"))
    compared = F.array(s, F.concat(F.lit("What is "), x, F.lit("?")), F.concat(F.lit("What is "), y, F.lit("?")), F.concat(F.lit("What are the differences between "), x, F.lit(" and "), y, F.lit("?")))
    parts = F.when(s.rlike(COMPARATIVE), compared).when(s.rlike(LIST_EXPLAIN), F.array(s, plain(LIST_EXPLAIN, 1), plain(LIST_EXPLAIN, 2))).when(s.rlike(CONJUNCTIVE), F.array(s, ask(CONJUNCTIVE, 1), ask(CONJUNCTIVE, 2)))
    return F.when(F.length(s) < 10, F.array(q)).otherwise(F.array_distinct(F.coalesce(parts, F.array(q))))


def keywords(q: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(q), F.lit("[a-zA-Z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(*TOPIC_STOP))


def expand(q: Column, most: int = 6) -> Column:
    """The query, and up to `most` aspects of its first three keywords."""
    head = F.array_join(F.slice(keywords(q), 1, 3), " ")
    return F.when(head == "", F.array(q)).otherwise(F.array(q, *[F.concat(head, F.lit(f" {a}")) for a in ASPECTS[:most]]))


def distinct_queries(qs: Column) -> Column:
    """Without queries that repeat an earlier one but for case."""
    low = F.transform(qs, F.lower)
    return F.filter(qs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def missing_terms(sentence: Column, context: Column) -> Column:
    """Sorted terms of the sentence that aren't words of the context."""
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(sentence), F.lit("[A-Za-z0-9][A-Za-z0-9_-]{2,}"), F.lit(0)), lambda t: ~t.isin(*FLARE_STOP)))
    known = F.regexp_extract_all(F.lower(context), F.lit("[A-Za-z0-9][A-Za-z0-9_-]*"), F.lit(0))
    return F.struct(F.array_sort(F.array_except(terms, known)).alias("missing"), F.size(terms).alias("terms"))


def flare_query(sentence: Column, query: Column, context: Column) -> Column:
    """A query for what a sentence says without support: under 0.4 of its terms are in the context. Null otherwise."""
    m = missing_terms(sentence, context)
    supported = (m["terms"] - F.size(m["missing"])) / m["terms"]
    return F.when((F.length(strip(sentence)) >= 30) & (m["terms"] > 0) & (supported < 0.4), F.concat_ws(" ", query, F.array_join(F.slice(m["missing"], 1, 5), " ")))


def valid_tenant(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-zA-Z0-9_-]{1,80}$"), F.lit(False))


def cache_key(**parts: Column) -> Column:
    """SHA-256 of the named parts as JSON with sorted keys; the query's white space and case don't count."""
    parts["query"] = strip(F.regexp_replace(F.lower(parts["query"]), r"\s+", " "))
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)
