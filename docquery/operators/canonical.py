"""The canonical table store: rows with cells, numbers and notes as maps; upsert, lookup, aggregation, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query, text
from . import lexical, tables

# The shapes of numbers in cells, and the names of units.
PLAIN_MM = r"^\s*(\d+(?:\.\d+)?)\s*\((\d+)\)"
FRACTION = r"^\s*(\d+)-(\d+)/(\d+)\s*$"
NUMBER_UNIT = r"(?i)^\s*(\d+(?:\.\d+)?)\s*([a-z]+)?"
UNITS = {"a": "amps", "amp": "amps", "amps": "amps", "v": "volts", "volts": "volts", "kv": "kv", "w": "watts", "watts": "watts", "kw": "kw", "in": "inches", "inch": "inches", "inches": "inches", "mm": "mm"}
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
LISTED_FIELDS, SKIPPED_FIELD, MISSING, EQUAL_WITHIN = 4, "Catalogue Number", "—", 0.01


def row_id(doc: Column, table: Column, row: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", doc, table, row.cast("string")), 256), 1, 16)


def numbers(cells: Column) -> Column:
    """MAP<STRING, DOUBLE> of a map of cells.

    'N (M)': h = N and h_mm = M; 'W-N/D': h = W + N / D (none if D is 0); else a leading number: h, and its unit's name if that is free.
    """
    pair = lambda k, v: F.struct(k.alias("k"), v.cast("double").alias("v"))
    empty = F.array().cast("array<struct<k:string,v:double>>")

    def of(e: Column) -> Column:
        h, v = e["key"], e["value"]
        num = lambda p, k: F.regexp_extract(v, p, k).try_cast("double")
        unit = F.lower(F.regexp_extract(v, NUMBER_UNIT, 2))
        alias = F.lit(None).cast("string")
        for u, name in UNITS.items():
            alias = F.when(unit == u, F.lit(name)).otherwise(alias)
        mixed = F.bround(num(FRACTION, 1) + num(FRACTION, 2) / F.nullif(num(FRACTION, 3), F.lit(0.0)), 4)
        plain = F.array(pair(h, num(NUMBER_UNIT, 1)))
        return (
            F.when(v.rlike(PLAIN_MM), F.array(pair(h, num(PLAIN_MM, 1)), pair(F.concat(h, F.lit("_mm")), num(PLAIN_MM, 2))))
            .when(v.rlike(FRACTION), F.when(mixed.isNotNull(), F.array(pair(h, mixed))).otherwise(empty))
            .when(v.rlike(NUMBER_UNIT), F.when(alias.isNotNull(), F.concat(plain, F.array(pair(alias, num(NUMBER_UNIT, 1))))).otherwise(plain))
            .otherwise(empty)
        )

    every = F.flatten(F.transform(F.map_entries(cells), of))
    keys = F.array_distinct(F.transform(every, lambda p: p["k"]))
    # a unit's name belongs to the first cell that has it
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(every, lambda p: p["k"] == k), 1)["v"]))


def notes(cells: Column) -> Column:
    """MAP<note, ''> of the circled digits, or of their written form [Note n]."""
    joined = F.array_join(F.map_values(cells), " ")
    written = F.transform(F.regexp_extract_all(joined, F.lit(r"\[Note (\d+)\]"), F.lit(1)), lambda n: F.substring(F.lit(CIRCLED), n.cast("int"), F.lit(1)))
    found = F.array_distinct(F.concat(F.regexp_extract_all(joined, F.lit(f"[{CIRCLED}]"), F.lit(0)), written))
    return F.map_from_arrays(found, F.transform(found, lambda _: F.lit("")))


def rows(cells: DataFrame, doc: DataFrame, key: str = "table_id") -> DataFrame:
    """Canonical rows of cells, with doc (table_id, tenant_id, doc_id, doc_title, section_title, page_start, page_end)."""
    r = tables.row_maps(cells, key).join(doc, key)
    nl = tables.sentence(F.col("headers"), F.col("values"), F.col("section_title"))
    nl = F.when((F.coalesce("doc_title", F.lit("")) != "") & ~F.contains(nl, F.col("doc_title")), F.concat(F.lit("["), "doc_title", F.lit("] "), nl)).otherwise(nl)
    clean = F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(F.replace(e["key"], F.lit("\0"), F.lit("")), F.replace(e["value"], F.lit("\0"), F.lit("")))))
    return r.select(
        "tenant_id", "doc_id", F.col(key).alias("table_id"), "section_title", "page_start", "page_end", row_id(F.col("doc_id"), F.col(key), F.col("row")).alias("row_id"), F.col("row").alias("row_index"),
        F.map_from_arrays("headers", "headers").alias("header_path"), clean.alias("cells"), numbers(F.col("cells")).alias("numeric_cells"), nl.alias("nl_sentence"), notes(F.col("cells")).alias("note_refs"),
    )


UPDATED = ("cells", "numeric_cells", "nl_sentence", "section_title", "note_refs")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new's rows: of a row_id that both have, UPDATED columns are new, the others stay old."""
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    j = old.withColumn("o", F.lit(True)).join(n, F.col("row_id") == F.col("n_row_id"), "full")
    pick = lambda c: F.when(F.col("n_row_id").isNotNull() & (F.lit(c in UPDATED) | F.col("o").isNull()), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(*[pick(c) for c in old.columns])


def entry_text(section: Column, cells: Column) -> Column:
    parts = F.transform(F.filter(F.map_entries(cells), lambda e: text.strip(e["value"]) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("; ", F.concat(F.lit("["), F.nullif(section, F.lit("")), F.lit("]")), parts)


def _compared(value: Column, op: str, wanted: Column | float) -> Column:
    w = wanted if isinstance(wanted, Column) else F.lit(float(wanted))
    return {"=": F.abs(value - w) < EQUAL_WITHIN, ">": value > w, ">=": value >= w, "<": value < w, "<=": value <= w}[op]


def passes(numeric: Column, field: str, op: str, wanted: float) -> Column:
    """A residual predicate: the field, else a field whose name holds it; rows that have neither pass."""
    near = F.get(F.filter(F.map_entries(numeric), lambda e: F.contains(F.lower(e["key"]), F.lit(field.lower()))), F.lit(0))["value"]
    return F.coalesce(_compared(F.coalesce(F.element_at(numeric, F.lit(field)), near), op, wanted), F.lit(True))


def aggregate(store: DataFrame, filters: list[tuple[str, str, float]], section: str | None = None, limit: int = 100) -> DataFrame:
    """Rows whose numbers meet all filters (rows without the field don't), by section and row."""
    out = store
    for field, op, wanted in filters:
        out = out.where(_compared(F.element_at("numeric_cells", F.lit(field)), op, wanted))
    if section:
        out = out.where(F.contains(F.lower("section_title"), F.lit(section.lower())))
    return out.orderBy("section_title", "row_index", "row_id").limit(limit)


def rows_with(codes: DataFrame, store: DataFrame) -> DataFrame:
    """store's rows with those of codes (code, ...) that their cells, as JSON in lower case, hold; a row once for each run that holds the code.

    A catalogue code lies in one run of letters, digits and hyphens: equi-joins by code and by run. Any other string meets every row.
    """
    asked = codes.withColumn("low", F.lower("code"))
    shaped = F.col("low").rlike(lexical.CODE_START + "[a-z0-9-]*$")
    runs = store.withColumn("run", F.explode(lexical.code_runs(F.to_json("cells"))))
    found = runs.join(lexical.codes_in(runs, asked.where(shaped)), "run").drop("run")
    found = found.join(asked.where(shaped), "low").select(*store.columns, *codes.columns)
    other = asked.where(~shaped)
    return found.unionByName(store.join(other, F.contains(F.lower(F.to_json("cells")), F.col("low"))).select(*store.columns, *codes.columns))


def lookup(queries: DataFrame, store: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, row_id, score): rows that hold a code of the query, by row, else rows that share its words, by share."""
    codes = queries.select("query_id", F.explode(F.array_distinct(query.catalogue_patterns(F.col("text")))).alias("code"))
    hit = rows_with(codes, store.select("row_id", "row_index", "cells")).select("query_id", "row_id", "row_index").distinct().withColumn("score", F.lit(2.0))
    rest = queries.join(hit.select("query_id").distinct(), "query_id", "left_anti")
    asked = rest.select("query_id", F.array_distinct(text.tokens(F.col("text"))).alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    held = store.select("row_id", "row_index", F.explode(F.array_distinct(text.tokens(F.col("nl_sentence")))).alias("term"))
    near = asked.join(held, "term").groupBy("query_id", "row_id", "row_index").agg(F.round(F.count(F.lit(1)) / F.first("n"), 6).alias("score"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_index", "row_id"))
    return hit.unionByName(near).withColumn("rank", rn).where(F.col("rank") <= limit)


def for_comparison(codes: DataFrame, store: DataFrame) -> DataFrame:
    """One row, the first, for each code (pos, code), in their order."""
    return rows_with(codes, store).withColumn("k", F.row_number().over(Window.partitionBy("pos").orderBy("row_index", "row_id"))).where("k = 1").drop("k")


def comparison(items: DataFrame, name: str, cells: str = "cells") -> DataFrame:
    """(field, item, value) of the items' fields, all of them for each item, with a dash where it has none."""
    long = items.select(F.col(name).alias("item"), F.explode(cells).alias("field", "value"))
    grid = long.select("field").distinct().crossJoin(items.select(F.col(name).alias("item")))  # fields times the few items compared
    return grid.join(long, ["field", "item"], "left").select("field", "item", F.coalesce("value", F.lit(MISSING)).alias("value"))


def comparison_table(items: DataFrame, name: str, names: list[str], cells: str = "cells") -> DataFrame:
    return comparison(items, name, cells).groupBy("field").pivot("item", names).agg(F.first("value")).orderBy("field")


def listed(df: DataFrame, order: str = "row_index") -> DataFrame:
    """One row: a numbered list of the rows' first four fields, without the catalogue number."""
    parts = F.array_join(F.transform(F.slice(F.filter(F.map_entries("cells"), lambda e: e["key"] != SKIPPED_FIELD), 1, LISTED_FIELDS), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    rows_ = df.agg(F.array_sort(F.collect_list(F.struct(order, parts.alias("p")))).alias("r"))
    return rows_.select(F.array_join(F.transform("r", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["p"])), "\n").alias("list"))
