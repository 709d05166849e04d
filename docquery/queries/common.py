"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text) of all user turns."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


TURNS = "(SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user')"


def sql_list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: DuckDB: the tokens of {0}.
TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda t: t NOT IN (" + sql_list(text.STOP_WORDS) + "))"
#: Events as a log of jobs: an event is a job, its user a tenant, its type a status.
STATUS = {"view": "queued", "click": "running", "purchase": "succeeded", "signup": "retry", "error": "failed"}


def status(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), c)


STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"


def jobs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").cast("string").alias("job_id"), F.col("user_id").cast("string").alias("tenant_id"), F.concat(F.lit("/in/"), F.col("event_id").cast("string")).alias("source_path"), status(F.col("event_type")).alias("status"), ts.alias("created_at"), ts.alias("updated_at"), "event_id", "value")
