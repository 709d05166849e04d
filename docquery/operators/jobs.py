"""The state of ingestion jobs as a log of events and as the latest state of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_SECONDS, ERROR_CHARS, ACTIVE = 1800, 4000, ("queued", "running", "retry")
COLUMNS = "job_id string, tenant_id string, source_path string, file_type string, status string, attempts int, force_reindex boolean, chunks_total bigint, chunks_inserted bigint, progress_pct double, error string, created_at timestamp, updated_at timestamp"


def created(paths: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """New queued jobs of (tenant_id, source_path, file_type); the id is a hash, so a rerun makes the same."""
    out = paths.select(F.substring(F.sha2(F.concat_ws("::", "tenant_id", "source_path", now.cast("string")), 256), 1, 32).alias("job_id"), "tenant_id", "source_path", "file_type")
    return out.select("*", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(force).alias("force_reindex"), F.lit(0).cast("bigint").alias("chunks_total"), F.lit(0).cast("bigint").alias("chunks_inserted"), F.lit(0.0).alias("progress_pct"), F.lit(None).cast("string").alias("error"), now.alias("created_at"), now.alias("updated_at"))


def claim(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The ids of the n oldest jobs that wait."""
    return jobs.where(F.col("status").isin("queued", "retry")).orderBy("created_at", "job_id").limit(n).select("job_id")


def started(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return updated(jobs, ids.select("job_id", F.lit("running").alias("status")), now, attempt=True)


def updated(jobs: DataFrame, changes: DataFrame, now: Column, attempt: bool = False) -> DataFrame:
    """jobs with the columns that changes (job_id, ...) has, and a new updated_at where it has a row."""
    cols = [c for c in changes.columns if c != "job_id"]
    j = jobs.join(changes.select("job_id", F.lit(True).alias("hit"), *[F.col(c).alias(f"n_{c}") for c in cols]), "job_id", "left")
    hit = F.coalesce("hit", F.lit(False))
    new = {c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) for c in cols} | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    if attempt:
        new["attempts"] = F.col("attempts") + hit.cast("int")
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in jobs.columns])


def completed(jobs: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """counts: (job_id, chunks_total, chunks_inserted)."""
    return updated(jobs, counts.withColumn("status", F.lit("succeeded")).withColumn("progress_pct", F.lit(100.0)), now)


def failed(jobs: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """errors: (job_id, error)."""
    return updated(jobs, errors.select("job_id", F.lit("failed").alias("status"), F.substring("error", 1, ERROR_CHARS).alias("error")), now)


def requeued(jobs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    stale = (F.col("status") == "running") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    return jobs.withColumn("status", F.when(stale, "queued").otherwise(F.col("status")))


def latest(log: DataFrame, key: str = "job_id", at: str = "updated_at") -> DataFrame:
    """The last event of each job."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("s")).select(key, "s.*")


def listed(jobs: DataFrame, tenant: str, limit: int = 50) -> DataFrame:
    return jobs.where(F.col("tenant_id") == tenant).orderBy(F.desc("created_at"), "job_id").limit(max(1, min(100, limit)))


def get(jobs: DataFrame, job_id: str, tenant: str | None = None) -> DataFrame:
    out = jobs.where(F.col("job_id") == job_id)
    return out if tenant is None else out.where(F.col("tenant_id") == tenant)


def active(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.coalesce(F.sum(F.col("status").isin(*ACTIVE).cast("int")), F.lit(0)).alias("active"))


def queue_position(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "retry")).withColumn("position", F.row_number().over(Window.partitionBy("tenant_id").orderBy("created_at", "job_id")))
