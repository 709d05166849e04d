"""Writes and rewrites of stored tables: appends of what is new, replacement by key, deletion, schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIQUE = ["tenant_id", "doc_id", "chunk_hash", "embedding_model"]


def new_only(incoming: DataFrame, stored: DataFrame, keys: list[str] | None = None, force: bool = False) -> DataFrame:
    """What isn't stored yet, once each; force: all of it."""
    keys = keys or UNIQUE
    once = incoming.dropDuplicates(keys)
    return once if force else once.join(stored.select(*keys), keys, "left_anti")


def replaced(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def without_sources(stored: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("tenant_id", "doc_id")) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def to_ingest(paths: DataFrame, indexed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Paths that are neither indexed nor under way."""
    active = jobs.where(F.col("status").isin("queued", "running", "retry")).select(F.col("source_path").alias("path"))
    return paths.join(indexed.select("path"), "path", "left_anti").join(active, "path", "left_anti")


def append(df: DataFrame, path: str, partitions: tuple[str, ...] = ("tenant_id", "embedding_model")) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def rewrite(df: DataFrame, path: str, scratch: str, partitions: tuple[str, ...] = ()) -> None:
    """Overwrites a table that df itself may read: it is written aside first."""
    df.write.mode("overwrite").parquet(scratch)
    out = df.sparkSession.read.parquet(scratch).write.mode("overwrite")
    (out.partitionBy(*partitions) if partitions else out).parquet(path)


def read(spark, path: str) -> DataFrame:
    """A table whose files may differ by columns that were added later."""
    return spark.read.option("mergeSchema", True).parquet(path)


def corpus_version(stored: DataFrame, at: str = "created_at") -> DataFrame:
    return stored.agg(F.coalesce(F.max(at).cast("string"), F.lit("empty")).alias("corpus_version"))


def tenant_checked(df: DataFrame, tenant: Column) -> DataFrame:
    from ..functions import query

    return df.where(query.valid_tenant(tenant))
