"""Tables as long DataFrames of cells (table_id, row, col, text): headers, fills, stitching, rendering, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

FILL_RATE, TITLE_CHARS = 0.5, 80


def markdown_cells(tables: DataFrame, key: str = "table_id", column: str = "markdown") -> DataFrame:
    """(table_id, row, col, text, is_header) of markdown tables: rows above the rule are headers; a row broken by a line end is joined again."""
    lines = F.filter(F.split(column, "\n"), lambda s: text.strip(s) != "")
    t = tables.select(key, F.posexplode(lines).alias("line", "s")).withColumn("rule", F.col("s").rlike(r"^\s*[|\-: ]+\s*$") & F.contains("s", F.lit("-")))
    order = Window.partitionBy(key).orderBy("line")
    # a row begins where the line before has ended one
    ended = F.coalesce(F.lag(text.strip(F.col("s")).endswith("|")).over(order), F.lit(True))
    t = t.withColumn("r", F.sum(ended.cast("int")).over(order))
    rows = t.groupBy(key, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), " ").alias("s"), F.max("rule").alias("rule"))
    rule = F.min(F.when(F.col("rule"), F.col("r"))).over(Window.partitionBy(key))
    rows = rows.withColumn("rule_at", rule).where("NOT rule AND rule_at IS NOT NULL")
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy("r")) - 1)
    cells = F.split(F.regexp_replace(F.regexp_replace(text.strip(F.col("s")), r"^\|", ""), r"\|$", ""), r"\|")
    out = rows.select(key, "row", (F.col("r") < F.col("rule_at")).alias("is_header"), F.posexplode(cells).alias("col", "text"))
    return out.select(key, "row", "col", text.strip(F.col("text")).alias("text"), "is_header")


def header_paths(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """(table_id, col, header): header rows inherit from the left, and a column's rows are joined by ' > ' without repeats in a row."""
    h = cells.where("is_header").withColumn("t", F.last(F.nullif("text", F.lit("")), True).over(Window.partitionBy(key, "row").orderBy("col")))
    parts = h.groupBy(key, "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "t"))), lambda x: x["t"]).alias("p"))
    filled = F.filter("p", lambda x: x.isNotNull())
    distinct = F.filter(filled, lambda x, i: (i == 0) | (x != F.coalesce(F.get(filled, i - 1), F.lit(""))))
    return parts.select(key, "col", F.array_join(distinct, " > ").alias("header"))


def fill(cells: DataFrame, key: str = "table_id", gated: bool = True) -> DataFrame:
    """Empty data cells take the value above, and those at the top the value below; gated: in sparse columns only."""
    order = Window.partitionBy(key, "col").orderBy("row")  # of all three, so that cells are sorted once
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.when(F.col("text") != "", F.col("text"))
    down = order.rowsBetween(Window.unboundedPreceding, 0)
    # where there is none above, the first below is the column's first
    filled = F.coalesce(x, F.last(x, True).over(down), F.first(x, True).over(whole), F.lit(""))
    rate = F.avg((text.strip(F.col("text")) != "").cast("double")).over(whole)
    return cells.withColumn("text", F.when(rate <= FILL_RATE, filled).otherwise(F.col("text")) if gated else filled)


def fill_rates(cells: DataFrame, key: str = "table_id") -> DataFrame:
    return cells.groupBy(key, "col").agg(F.avg((text.strip(F.col("text")) != "").cast("double")).alias("rate"))


def header_rows(cells: DataFrame, key: str = "table_id", most: int = 4) -> DataFrame:
    """(table_id, row, is_header): short, upper-case or digit-free cells throughout, the next row has a digit, and all rows above are headers too."""
    plain = (F.length("text") <= 30) | (F.col("text") == F.upper("text")) | ~F.col("text").rlike(r"\d")
    r = cells.groupBy(key, "row").agg(F.every(plain).alias("plain"), F.max(F.col("text").rlike(r"\d")).alias("digit"))
    order = Window.partitionBy(key).orderBy("row")
    like = F.col("plain") & F.coalesce(F.lead("digit").over(order), F.lit(False)) & (F.col("row") < most)
    return r.select(key, "row", F.coalesce(like, F.lit(False)).alias("is_header"))


def row_maps(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """(table_id, row, headers, values, cells): each data row, not blank, as arrays in order of column and as a map."""
    named = cells.where("NOT is_header").join(header_paths(cells, key), [key, "col"], "left")
    name = F.coalesce(F.nullif("header", F.lit("")), F.concat(F.lit("col_"), F.col("col").cast("string")))
    rows = named.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("col", name.alias("h"), F.col("text").alias("v")))).alias("x"))
    rows = rows.where(F.exists("x", lambda c: text.strip(c["v"]) != ""))
    # a header that occurs twice keeps its last value
    last = F.filter("x", lambda c, i: ~F.exists(F.slice("x", i + 2, F.size("x")), lambda d: d["h"] == c["h"]))
    return rows.select(key, "row", F.transform("x", lambda c: c["h"]).alias("headers"), F.transform("x", lambda c: c["v"]).alias("values"), F.map_from_entries(F.transform(last, lambda c: F.struct(c["h"], c["v"]))).alias("cells"))


def sentence(headers: Column, values: Column, section: Column) -> Column:
    """[section] h: v; h: v. without blanks."""
    parts = F.filter(F.zip_with(headers, values, lambda h, v: F.when(text.strip(v) != "", F.concat(h, F.lit(": "), text.strip(v)))), lambda p: p.isNotNull())
    return F.concat(F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("["), section, F.lit("] "))).otherwise(F.lit("")), F.array_join(parts, "; "), F.lit("."))


def markdown_row(values: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(values, lambda v: F.replace(v, F.lit("|"), F.lit(r"\|"))), " | "), F.lit(" |"))


def fitted(values: Column, n: Column) -> Column:
    """Padded with blanks or cut to n."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(""), n)), F.lit(1), n)


def markdown(headers: Column, rows: Column) -> Column:
    """A markdown table of ARRAY<ARRAY<STRING>> rows."""
    n = F.size(headers)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(markdown_row(headers), rule), F.transform(rows, lambda r: markdown_row(fitted(r, n)))), "\n")


def html(headers: Column, rows: Column) -> Column:
    esc = lambda v: F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda v: F.concat(F.lit(f"<{tag}>"), esc(v), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table><thead>"), line(headers, "th"), F.lit("</thead><tbody>"), F.array_join(F.transform(rows, lambda r: line(r, "td")), ""), F.lit("</tbody></table>"))


def row_chunks(cells: DataFrame, key: str = "table_id", title: Column | None = None, around: int = 1) -> DataFrame:
    """(table_id, row, text, nl, cells): a chunk for each data row, with the header and `around` rows on either side."""
    rows = row_maps(cells, key).withColumn("md", markdown_row(F.col("values")))
    near = Window.partitionBy(key).orderBy("row").rowsBetween(-around, around)
    rule = F.concat(F.lit("| "), F.array_join(F.transform("headers", lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.array_join(F.collect_list("md").over(near), "\n")
    s = title if title is not None else F.lit("")
    return rows.select(key, "row", F.concat_ws("\n", markdown_row(F.col("headers")), rule, body).alias("text"), sentence(F.col("headers"), F.col("values"), s).alias("nl"), "cells")


def grouped_chunks(cells: DataFrame, key: str = "table_id", size: int = 5) -> DataFrame:
    """(table_id, chunk, text): `size` data rows to a chunk, each under the header."""
    rows = row_maps(cells, key).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("row")) - 1)
    g = rows.withColumn("chunk", F.floor(F.col("n") / size).cast("int")).groupBy(key, "chunk")
    g = g.agg(F.first("headers").alias("headers"), F.transform(F.array_sort(F.collect_list(F.struct("n", "values"))), lambda x: x["values"]).alias("rows"))
    return g.select(key, "chunk", markdown(F.col("headers"), F.col("rows")).alias("text"))


def is_continuation(a: Column, b: Column) -> Column:
    """Whether table b goes on with table a; both STRUCT<title, columns, headers, first_row_text>."""
    titles = (F.coalesce(a["title"], F.lit("")) == "") | (F.coalesce(b["title"], F.lit("")) == "") | (a["title"] == b["title"])
    shared = F.size(F.array_intersect(a["headers"], b["headers"])) / F.greatest(F.size(a["headers"]), F.lit(1))
    both = (F.size(a["headers"]) > 0) & (F.size(b["headers"]) > 0)
    return titles & (F.abs(a["columns"] - b["columns"]) <= 1) & F.when(both, shared > 0.7).otherwise(~b["first_row_text"])


def stitched(tables: DataFrame) -> DataFrame:
    """Adds stitched_id: the table of an earlier page that (doc_id, page, pos, table_id, title, columns, headers, first_row_text) goes on.

    The last table of a page and the first of the next are candidates; chains over many pages are one table.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    t = tables.withColumn("this", F.struct("title", "columns", "headers", "first_row_text", "page"))
    before = F.lag("this").over(order)
    goes_on = F.coalesce(before["page"].eqNullSafe(F.col("page") - 1) & is_continuation(before, F.col("this")), F.lit(False))
    t = t.withColumn("island", F.sum((~goes_on).cast("int")).over(order))
    return t.withColumn("stitched_id", F.first("table_id").over(Window.partitionBy("doc_id", "island").orderBy("page", "pos"))).drop("this", "island")


def nearby_title(surrounding: Column, fallback: Column) -> Column:
    """The last line above a table that looks like a heading."""
    lines = F.filter(F.transform(F.reverse(F.split(surrounding, "\n")), text.strip), lambda s: (s != "") & (F.length(s) <= TITLE_CHARS) & ~s.endswith(".") & ~F.contains(s, F.lit("|")))
    return F.coalesce(F.get(lines, F.lit(0)), fallback)


def assembled_html(chunks: DataFrame) -> DataFrame:
    """(table_id, html) of row chunks (table_id, row_index, headers, values), in order of row."""
    g = chunks.groupBy("table_id").agg(F.min_by("headers", "row_index").alias("h"), F.transform(F.array_sort(F.collect_list(F.struct("row_index", "values"))), lambda x: x["values"]).alias("r"))
    return g.select("table_id", html(F.col("h"), F.col("r")).alias("html"))
