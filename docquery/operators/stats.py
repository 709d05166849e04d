"""Corpus statistics and the latency histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency buckets, in seconds.
BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def corpus(chunks: DataFrame, doc: str = "doc_id", kind: str = "file_type", approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), distinct(doc).alias("documents"), distinct(kind).alias("file_types"))


def by_type(chunks: DataFrame, doc: str = "doc_id", kind: str = "file_type") -> DataFrame:
    g = chunks.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("file_type"))
    return g.agg(F.countDistinct(doc).alias("doc_count"), F.count(F.lit(1)).alias("chunk_count")).orderBy(F.desc("chunk_count"), "file_type")


def histogram(samples: DataFrame, value: str, label: str | None = None, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(label, le, n, total, sum): how many samples are within each bound, cumulative, in one pass."""
    keys = [label] if label else []
    wide = samples.groupBy(*keys).agg(F.count(value).alias("total"), F.sum(value).alias("sum"), *[F.sum((F.col(value) <= b).cast("long")).alias(f"b{k}") for k, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.coalesce(f"b{k}", F.lit(0)).alias("n")) for k, b in enumerate(bounds)])
    return wide.select(*keys, "total", "sum", F.explode(pairs).alias("x")).select(*keys, "x.le", "x.n", "total", "sum")
