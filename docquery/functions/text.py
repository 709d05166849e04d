"""Row-level text functions; every one takes and gives Columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't count as tokens.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above", "below", "between", "out", "off", "over", "under", "again", "further", "then",
    "once", "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "neither", "each", "every", "all", "any", "few", "more", "most", "other",
    "some", "such", "no", "only", "own", "same", "than", "too", "very", "just", "because", "if", "when", "where", "how", "what", "which", "who",
    "whom", "this", "that", "these", "those", "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her", "it", "its", "they",
    "them", "their", "about",
)
# Characters normalised in catalogue texts.
PAIRS = (("¹⁄", "1/"), ("³⁄", "3/"), ("⁵⁄", "5/"), ("⁷⁄", "7/"))
SINGLE_FROM, SINGLE_TO = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "01234567890123456789"
WIDE = (
    ("½", "1/2"), ("¼", "1/4"), ("¾", "3/4"), ("⅛", "1/8"), ("⅜", "3/8"), ("⅝", "5/8"), ("⅞", "7/8"), ("⅓", "1/3"), ("⅔", "2/3"), ("®", "(R)"), ("™", "(TM)"), ("©", "(C)"),
    *((c, f" [Note {k}]") for k, c in enumerate("①②③④⑤⑥⑦⑧⑨⑩", 1)),
)
# File extensions of each category.
FILE_TYPES = {
    "pdf": (".pdf",), "docx": (".docx", ".doc"), "xlsx": (".xlsx", ".xls"), "pptx": (".pptx", ".ppt"), "csv": (".csv",),
    "text": (".txt", ".text", ".md", ".log", ".json", ".xml"),
    "code": (".py", ".js", ".java", ".cpp", ".c", ".h", ".cs", ".go", ".rs", ".rb", ".php", ".sql", ".html", ".css", ".sh"),
    "email": (".eml", ".msg"), "url": (".url", ".webloc"), "archive": (".zip", ".tar", ".gz", ".tgz", ".rar"),
    "image": (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".gif", ".webp"), "video": (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv"),
    "subtitle": (".srt", ".ass", ".ssa", ".vtt"),
}
TICK = r"[✓✔☑☒◉]|\[[xX]\]|\([xX]\)"


# Words of pages that hold data worth extracting, and the shape of their codes.
DATA_WORDS = (
    "amps", "dimensions", "loadcentre", "catalogue", "catalog", "breaker", "suffix", "circuits", "skid",
    "fault", "indicator", "status", "dashboard", "procedure", "step", "warning", "plc", "valve", "turbine", "nl/min",
    "prerequisite", "defect", "root cause", "corrective action", "maintenance", "log",
    "revenue", "net profit", "fiscal", "quarter", "ebitda", "footnote", "discrepancy", "compliance", "yoy",
    "salary", "ctc", "experience", "requirements", "responsibilities",
)
DATA_CODE = r"\b[A-Z]{2,4}[0-9]{3,5}[A-Z]*\b"


def looks_extractable(c: Column) -> Column:
    """Whether a page is dense with data: four of the words at least, or five codes."""
    words = F.size(F.filter(F.array(*map(F.lit, DATA_WORDS)), lambda w: F.contains(F.lower(c), w)))
    return F.coalesce((words >= 4) | (F.regexp_count(c, F.lit(DATA_CODE)) >= 5), F.lit(False))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use refers to it, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def or_else(c: Column, other: Column) -> Column:
    """c unless it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def tokens(c: Column, pattern: str = "[a-z0-9_]+", stop: bool = True) -> Column:
    """Lower-case tokens in order, repeats kept, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS)) if stop else found


def words(c: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def without_citation(c: Column) -> Column:
    return F.regexp_replace(c, r"\[Source:.*?\]\n?", "")


def normalize_symbols(c: Column) -> Column:
    """Superscripts, fractions, marks and circled digits as ASCII; a catalogue code is parted from a rating or phase that touches it."""
    for a, b in PAIRS:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.translate(c, SINGLE_FROM, SINGLE_TO)
    for a, b in WIDE:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"\b([A-Z0-9]{4,12})\s*(\d{1,4}[AVW])\b", "$1 | $2")
    return F.regexp_replace(c, r"\b([A-Z0-9]{4,12})\s*(\d\s*Phase)\b", "$1 | $2")


def mark_answers(c: Column) -> Column:
    """Lines with a tick are labelled as the correct answer."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda s: F.when(s.rlike(TICK), F.concat(F.lit("[CORRECT ANSWER] "), s)).otherwise(s)), "\n")


def chunk_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))
    out = F.lit("unknown")
    for kind, exts in FILE_TYPES.items():
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out


def is_supported(path: Column) -> Column:
    return file_type(path) != "unknown"


def page_header(path: Column, page: Column) -> Column:
    return F.concat(F.lit("["), basename(path), F.lit(", Page "), page.cast("string"), F.lit("]\n"))


def chunk_type(c: Column) -> Column:
    """The type that the text's own prefix tells."""
    starts = lambda *p: F.exists(F.array(*map(F.lit, p)), lambda x: F.startswith(c, x))
    return F.when(starts("[TABLE", "[EXCEL SHEET", "[CSV DATA"), "table").when(starts("[IMAGE OCR", "[FULL PAGE OCR"), "image_ocr").when(starts("[VIDEO SUBTITLE", "[SUBTITLE"), "subtitle").otherwise("text")


def compress(c: Column, limit: int = 3500) -> Column:
    """Long prose cut at its last space, if that is in the second half; tables are left whole."""
    head = F.substring(c, 1, limit)
    last = F.lit(limit) - F.locate(" ", F.reverse(head))  # 0-based; limit if there is none
    cut = F.when((F.locate(" ", head) > 0) & (last > limit // 2), F.substring(c, F.lit(1), last)).otherwise(head)
    table = c.contains("[TABLE") | c.contains("| ")
    return F.when((F.length(c) > limit) & ~table, F.concat(cut, F.lit("..."))).otherwise(c)


def citation(source: Column, page: Column, section: Column) -> Column:
    """[Source: file, Page p, Section: s], leaving out what is unknown."""
    parts = F.concat_ws(", ", F.concat(F.lit("Source: "), basename(source)), F.concat(F.lit("Page "), page.cast("string")), F.concat(F.lit("Section: "), F.nullif(section, F.lit(""))))
    return F.concat(F.lit("["), parts, F.lit("]"))


def with_citation(label: Column, c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("[Source:")), c).otherwise(F.concat(label, F.lit("\n"), c))


def without_headers(c: Column) -> Column:
    """Without the page and part headers that ingest put before the text."""
    return F.regexp_replace(c, r"\[.*?(?:Page|Part)\s*\d+\]\s*", "")


def extractive_answer(source: Column, page: Column, c: Column, limit: int = 4000) -> Column:
    return F.concat(F.lit("["), basename(source), F.lit(", Page "), page.cast("string"), F.lit("]\n"), F.substring(c, 1, limit), F.when(F.length(c) > limit, "...").otherwise(""))


def sentences(c: Column, least: int = 11) -> Column:
    """Stripped sentences of at least that many characters."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) >= least)


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and page furniture go, tags become line ends, blank lines go."""
    c = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|header)\b.*?</\1\s*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "\n")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda s: s != ""), "\n")


def first_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"https?://\S+", 0), r"[\"\]<].*$", "")


def subtitle_text(c: Column) -> Column:
    """Subtitle lines without styling, counters or times."""
    c = F.replace(F.regexp_replace(c, r"\{[^}]*\}|<[^>]*>", ""), F.lit("\\N"), F.lit("\n"))
    keep = lambda s: (s != "") & ~s.rlike(r"^\d+$") & ~s.contains("-->")
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), keep), "\n")


def strip_table_lines(c: Column, tables: Column) -> Column:
    """Text lines that repeat a table's line, or share over 0.4 of their tokens with the tables (0.6 of three or fewer), go."""
    pattern = F.lit("[A-Za-z0-9]{2,}[A-Za-z0-9-]*")
    low = F.lower(F.array_join(tables, "\n"))
    rows = F.filter(F.transform(F.split(low, "\n"), strip), lambda s: s != "")
    known = F.array_distinct(F.regexp_extract_all(low, pattern, F.lit(0)))

    def keep(line):
        own = F.regexp_extract_all(F.lower(line), pattern, F.lit(0))
        share = F.size(F.filter(own, lambda t: F.array_contains(known, t))) / F.size(own)
        repeated = (F.size(own) > 0) & (share > F.when(F.size(own) <= 3, 0.6).otherwise(0.4))
        return (strip(line) == "") | ~(F.array_contains(rows, strip(F.lower(line))) | F.coalesce(repeated, F.lit(False)))

    return F.array_join(F.filter(F.split(c, "\n"), keep), "\n")
