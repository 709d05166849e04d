"""Files of many kinds to pages; a file that can't be parsed is a row with its error."""

from __future__ import annotations

import email
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from email import policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking
from ..schemas import PARSED
from . import office

Parser = Callable[[str, bytes], list[str]]
MAX_ARCHIVE = 1 << 30
#: Parsers of binary formats, PDF and image decoders among them, are registered where they are to be had.
_PARSERS: dict[str, Parser] = {}


def register_parser(file_type: str, parser: Parser) -> None:
    """parser: (path, bytes) -> the texts of its pages; errors that it raises become rows."""
    _PARSERS[file_type] = parser


def scan(spark: SparkSession, root: str, include: list[str] | None = None) -> DataFrame:
    """(path, file_type, length, content) of the supported files under root; file and folder names with a leading dot are skipped."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    df = df.where(~F.regexp_replace("path", r"^[a-z]+:/*", "/").rlike(r"/\.[^/]")).withColumn("file_type", text.file_type(F.col("path")))
    kinds = include or [k for k in text.FILE_TYPES]
    return df.where(F.col("file_type").isin(*kinds)).select("path", "file_type", "length", "content")


def parse_email(path: str, raw: bytes) -> list[str]:
    m = email.message_from_bytes(raw, policy=policy.default)
    heads = [f"{h}: {m[h]}" for h in ("Subject", "From", "To", "Date") if m[h]]
    plain, html = [], []
    for part in m.walk():
        if part.get_content_type() == "text/plain":
            plain.append(part.get_content())
        elif part.get_content_type() == "text/html":
            html.append(re.sub(r"<[^>]*>", " ", part.get_content()))
    return ["\n".join([*heads, "", *(plain or html)]).strip()]


def archive_members(name: str, raw: bytes, limit: int = MAX_ARCHIVE) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of an archive's supported members: none outside its root, no dot files, `limit` bytes in all at most."""
    supported = {e for exts in text.FILE_TYPES.values() for e in exts}
    used = 0

    def fine(n: str, size: int) -> bool:
        nonlocal used
        parts = n.replace("\\", "/").split("/")
        if n.startswith("/") or ".." in parts or parts[-1].startswith(".") or "." + parts[-1].rpartition(".")[2].lower() not in supported:
            return False
        if used + size > limit:
            raise ValueError(f"{name}: archive exceeds {limit} bytes")
        used += size
        return True

    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                if not i.is_dir() and fine(i.filename, i.file_size):
                    yield i.filename, z.read(i)
    else:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for i in t:
                if i.isfile() and fine(i.name, i.size):
                    yield i.name, t.extractfile(i).read()


def unpacked(files: DataFrame, depth: int = 2) -> DataFrame:
    """files with archives replaced by their members, archives inside archives too; a broken one stays, for its error."""

    def run(frames):
        for pdf in frames:
            out = []
            for path, kind, raw in zip(pdf["path"], pdf["file_type"], pdf["content"], strict=True):
                try:
                    inside = list(archive_members(path, raw)) if kind == "archive" else None
                except Exception:
                    inside = None
                out += [(f"{path}!/{n}", b) for n, b in inside] if inside is not None else [(path, raw)]
            yield pd.DataFrame(out, columns=["path", "content"])

    for _ in range(depth):
        members = files.where("file_type = 'archive'").select("path", "file_type", "content").mapInPandas(run, "path string, content binary")
        members = members.select("path", text.file_type(F.col("path")).alias("file_type"), F.length("content").cast("bigint").alias("length"), "content")
        files = files.where("file_type != 'archive'").unionByName(members)
    return files


def parse(files: DataFrame) -> DataFrame:
    """(path, file_type, success, error, page_num, text) of (path, file_type, content). Texts of all kinds stay in the JVM."""
    plain = ("text", "code", "url", "subtitle", "html")
    kind = F.when(F.lower("path").rlike(r"\.html?$"), "html").otherwise(F.col("file_type"))
    f = files.withColumn("kind", kind)
    t = F.coalesce(F.col("content").cast("string"), F.lit(""))
    t = F.regexp_replace(t, "\r\n?", "\n")
    pages = (
        F.when(F.col("kind") == "code", F.array(chunking.code_page(F.col("path"), t)))
        .when(F.col("kind") == "html", F.array(text.html_text(t)))
        .when(F.col("kind") == "url", F.array(F.concat(F.lit("[URL: "), text.first_url(t), F.lit("]\n(not fetched)"))))
        .when(F.col("kind") == "subtitle", F.array(F.concat(F.lit("[SUBTITLE: "), text.basename(F.col("path")), F.lit("]\n"), text.subtitle_text(t))))
        .otherwise(chunking.text_pages(t))
    )
    texts = f.where(F.col("kind").isin(*plain)).select("path", "file_type", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), F.posexplode(pages).alias("p", "text"))
    texts = texts.select("path", "file_type", "success", "error", (F.col("p") + 1).alias("page_num"), "text")
    csv = f.where("kind = 'csv'").select("path", F.posexplode(F.split(t, "\n")).alias("line", "s")).where("s <> ''")
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "s"), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"')))
    csv = chunking.csv_pages(csv.withColumn("cells", cells), "path").select(F.col("file").alias("path"), F.lit("csv").alias("file_type"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), "page_num", "text")
    parsers = {"email": parse_email} | office.PARSERS | _PARSERS

    def run(frames):
        for pdf in frames:
            out = []
            for path, k, raw in zip(pdf["path"], pdf["file_type"], pdf["content"], strict=True):
                try:
                    if k not in parsers:
                        raise ValueError(f"no parser for {k} files")
                    out += [(path, k, True, None, n, s) for n, s in enumerate(parsers[k](path, raw), 1)]
                except Exception as e:  # an error is a row
                    out.append((path, k, False, f"{type(e).__name__}: {e}"[:4000], None, None))
            yield pd.DataFrame(out, columns=["path", "file_type", "success", "error", "page_num", "text"]).astype({"page_num": "Int32"})

    rest = f.where(~F.col("kind").isin(*plain, "csv")).select("path", "file_type", "content").mapInPandas(run, PARSED)
    return texts.unionByName(csv).unionByName(rest)


def first_success(*parsed: DataFrame) -> DataFrame:
    """For each path the pages of the first of several parses that succeeded, else the last one's error."""
    out = parsed[-1]
    for p in reversed(parsed[:-1]):
        good = p.where("success")
        out = good.unionByName(out.join(good.select("path").distinct(), "path", "left_anti"))
    return out


def layout_pages(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_num, text, section_title) of layout items (key, page_no, ord, item_type, text): headers run on, tables are labelled."""
    from pyspark.sql import Window

    running = F.last(F.when(F.col("item_type") == "SectionHeaderItem", F.col("text")), True).over(Window.partitionBy(key).orderBy("page_no", "ord"))
    i = items.withColumn("section", running)
    part = (
        F.when(F.col("item_type") == "SectionHeaderItem", F.concat(F.lit("## "), "text"))
        .when(F.col("item_type") == "TableItem", F.concat(F.lit("[TABLE - Page "), F.col("page_no").cast("string"), F.when(F.col("section").isNotNull(), F.concat(F.lit(" (section: "), "section", F.lit(")"))).otherwise(""), F.lit("]\n"), "text"))
        .otherwise(text.normalize_symbols(text.mark_answers(F.col("text"))))
    )
    g = i.withColumn("part", part).groupBy(key, "page_no").agg(F.array_sort(F.collect_list(F.struct("ord", "part", "section"))).alias("x"))
    return g.select(key, F.col("page_no").alias("page_num"), F.array_join(F.transform("x", lambda p: p["part"]), "\n\n").alias("text"), F.element_at("x", -1)["section"].alias("section_title"))


def vision_text(item) -> F.Column:
    """A vision model's JSON item (STRING) as a line of key: value pairs without null-ish values."""
    pairs = F.map_entries(F.from_json(item, "map<string,string>"))
    keep = F.filter(pairs, lambda e: e["value"].isNotNull() & ~F.lower(text.strip(e["value"])).isin("", "null", "none", "n/a", "-"))
    return F.array_join(F.transform(keep, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def formats() -> dict[str, list[str]]:
    return {k: list(v) for k, v in text.FILE_TYPES.items()}
