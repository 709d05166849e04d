"""Ranked candidates to the context of an answer: neighbours, order, caps, budgets, labels, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import retrieval

# Sizes of windows, caps and budgets.
NEIGHBOURS, SEEDS, BUDGET, PER_SECTION, MAP_REDUCE, BROAD_CHUNKS, BROAD_CHARS, SECTION_RANGE = 5, 5, 100_000, 30, 80_000, 32, 26_000, 20


def neighbours(seeds: DataFrame, chunks: DataFrame, width: int = NEIGHBOURS, most: int = SEEDS, doc: str = "doc_id", at: str = "section") -> DataFrame:
    """(query_id, doc, at, seed_rank): chunks within `width` places of the query's first seeds (query_id, rank, doc, at).

    The seeds are exploded to the places wanted, so the range join is an equi-join, shuffled by (doc, place).
    """
    first = seeds.where(F.col("rank") <= most).select("query_id", F.col("rank").alias("seed_rank"), doc, F.explode(F.sequence(F.greatest(F.col(at) - width, F.lit(0)), F.col(at) + width)).alias(at))
    wanted = first.groupBy("query_id", doc, at).agg(F.min("seed_rank").alias("seed_rank"))
    return chunks.join(wanted, [doc, at])


def ordered(df: DataFrame, ordering: str = "relevance") -> DataFrame:
    """Adds pos, the place in the wanted order within a query: document_order, section_order or relevance."""
    by = {"document_order": ["source", "section"], "section_order": ["section", "source"], "relevance": [F.desc("score")]}[ordering]
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*by, "chunk_id")))


def by_section(df: DataFrame, most: int = PER_SECTION) -> DataFrame:
    """Adds pos: sections by best score, within one by ordinal and `most` at most, chunks without section last."""
    key = F.coalesce(text.or_else(F.col("section_id"), F.lit(None)), text.or_else(F.col("section_title"), F.lit(None)))
    g = df.withColumn("key", key).withColumn("best", F.max("score").over(Window.partitionBy("query_id", "key")))
    g = g.withColumn("in_section", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("section", "chunk_id"))).where(F.col("key").isNull() | (F.col("in_section") <= most))
    last = F.col("key").isNull()
    return g.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(last, F.desc("best"), "key", "section", "chunk_id"))).drop("key", "best", "in_section")


def _chars(df: DataFrame) -> Column:
    return F.col("chars") if "chars" in df.columns else F.length("text")


def token_budget(df: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The prefix, by pos, whose characters fit the budget; the first always stays. It stops at the first overflow.

    df has the texts, or only their lengths as `chars`, which is all that is dealt out and sorted then.
    """
    total = F.sum(_chars(df)).over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("total", total).where((F.col("total") <= budget) | (F.col("pos") == 1)).drop("total")


def greedy_budget(df: DataFrame, budget: int = BUDGET, most: int | None = None) -> DataFrame:
    """By pos, what still fits; an item that doesn't is skipped, not the end. A fold over a query's few candidates, with texts or `chars`."""
    items = F.array_sort(F.collect_list(F.struct("pos", "chunk_id", _chars(df).alias("len"))))
    kind = "struct<used:bigint,kept:array<bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept")).cast(kind)

    def step(acc, x):
        fits = (acc["used"] + x["len"] <= budget) & (F.lit(True) if most is None else F.size(acc["kept"]) < most)
        return F.when(fits, F.struct((acc["used"] + x["len"]).alias("used"), F.array_append(acc["kept"], x["chunk_id"].cast("bigint")).alias("kept")).cast(kind)).otherwise(acc)

    kept = df.groupBy("query_id").agg(F.aggregate(items, start, step)["kept"].alias("kept"))
    return df.join(kept.select("query_id", F.explode("kept").alias("chunk_id")), ["query_id", "chunk_id"], "left_semi")


def broad_context(df: DataFrame) -> DataFrame:
    """For broad queries: the first source's chunks in order, 32 and 26,000 characters at most."""
    first = df.groupBy("query_id").agg(F.min_by("source", F.struct("rank", "chunk_id")).alias("source"))
    own = ordered(df.join(first, ["query_id", "source"]), "document_order").where(F.col("pos") <= BROAD_CHUNKS)
    return greedy_budget(own, BROAD_CHARS)


def map_reduce_needed(df: DataFrame, limit: int = MAP_REDUCE) -> DataFrame:
    return df.groupBy("query_id").agg((F.sum(F.length("text")) > limit).alias("map_reduce"))


def optimize(df: DataFrame, ordering: str = "relevance", budget: int = BUDGET) -> DataFrame:
    """Candidates (query_id, chunk_id, rank, score, text, source, section, ...) without exact and near copies, ordered, flagged for map-reduce, cut to the budget."""
    once = retrieval.text_duplicates(df, text.strip(text.without_citation(F.col("text"))))
    kept = retrieval.near_duplicates(once, key="chunk_id").select("query_id", "chunk_id")
    out = ordered(once.join(kept, ["query_id", "chunk_id"], "left_semi"), ordering)
    return token_budget(out.join(map_reduce_needed(out), "query_id"), budget)


def labelled(df: DataFrame) -> DataFrame:
    """Compressed text under its citation label."""
    label = text.citation(F.col("source"), F.col("page_num"), F.coalesce(text.or_else(F.col("section_title"), F.lit(None)), F.col("section").cast("string")))
    return df.withColumn("citation", label).withColumn("text", text.with_citation(label, text.compress(F.col("text"))))


def sources(df: DataFrame) -> DataFrame:
    """(query_id, source, page_num, citation, n): distinct file and page of a query's context, in order, with the first label."""
    file = df.withColumn("source", text.basename(F.col("source")))
    s = file.groupBy("query_id", "source", "page_num").agg(F.min_by("citation", "pos").alias("citation"), F.min("pos").alias("first"))
    return s.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")


def completeness(df: DataFrame) -> DataFrame:
    """(query_id, section_id, included, total, warning) of the sections that the context has only in part."""
    g = df.where(F.col("section_id").isNotNull()).groupBy("query_id", "section_id").agg(F.count(F.lit(1)).alias("included"), F.max("total_chunks_in_section").alias("total"))
    warning = F.format_string("Section '%s': only %d of %d chunks included", "section_id", "included", "total")
    return g.where("included < total").withColumn("warning", warning)


def append_missing(base: DataFrame, more: DataFrame) -> DataFrame:
    """base and the rows of more whose (query_id, chunk_id) base lacks; the first of each stays."""
    both = base.withColumn("part", F.lit(0)).unionByName(more.withColumn("part", F.lit(1)))
    return both.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("part", "rank"))).where("k = 1").drop("k", "part")


def html_context(df: DataFrame) -> DataFrame:
    """(query_id, html, plain): tables rendered, the rest as text, in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "is_table", "text")))
    part = lambda table, sep: F.array_join(F.transform(F.filter("rows", lambda r: r["is_table"] == table), lambda r: r["text"]), sep)
    return df.groupBy("query_id").agg(rows.alias("rows")).select("query_id", part(True, "\n").alias("html"), part(False, "\n\n").alias("plain"))


def prompt_context(df: DataFrame) -> DataFrame:
    """(query_id, context): the texts in order, without their headers, set apart by rules."""
    rows = F.array_sort(F.collect_list(F.struct("pos", text.without_headers(F.col("text")).alias("t"))))
    return df.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n---\n\n").alias("context"))
