"""Continuous ingest: new files of a folder become pages and chunks; the checkpoint is the queue.

A file that appears is parsed once; a batch that is repeated after a failure changes nothing, for its chunks are anti-joined
with what is stored. Jobs that run for too long are put back by a processing-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text
from ..operators import chunking, jobs, store
from ..sources import files

FILE = "path string, modificationTime timestamp, length bigint, content binary"
KEYS = ["tenant_id", "doc_id", "chunk_hash"]


def watch(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    df = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)
    return df.select("path", text.file_type(F.col("path")).alias("file_type"), "length", "content").where("file_type != 'unknown'")


def chunks_of(arrived: DataFrame, tenant: str = "default") -> DataFrame:
    pages = files.parse(files.unpacked(arrived)).where("success")
    c = chunking.chunks(pages.select(F.struct("path", "page_num", "file_type").alias("page"), "text"), "page").select(F.col("page.path").alias("source"), "page.page_num", "page.file_type", "parent_idx", "child_idx", "parent_text", "text")
    return chunking.contextual(c).select(F.lit(tenant).alias("tenant_id"), F.col("source").alias("doc_id"), "*")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, tenant: str = "default", available_now: bool = False) -> StreamingQuery:
    def batch(arrived: DataFrame, _: int) -> None:
        new = chunks_of(arrived, tenant)
        try:
            stored = spark.read.parquet(out)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = new.limit(0)
        store.new_only(new, stored, KEYS).write.mode("append").partitionBy("tenant_id").parquet(out)

    w = watch(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")).start()


def once_each(stream: DataFrame, at: str | None = None, delay: str = "1 day", keys: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """Without rows whose keys have been seen; with an event time, what is remembered is bounded by the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys)) if at else stream.dropDuplicates(list(keys))


class Requeue(StatefulProcessor):
    """Keeps each job's latest status, and tells of a job that has run for over `seconds` without news."""

    def __init__(self, seconds: int = jobs.STALE_SECONDS):
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.status = handle, handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            last = pdf.sort_values("updated_at")["status"].iloc[-1]
            self.status.update((last,))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if last == "running":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ms)
        yield pd.DataFrame({"job_id": [], "status": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"job_id": [key[0]], "status": ["queued"]})

    def close(self) -> None:
        pass


def stale_jobs(log: DataFrame, seconds: int = jobs.STALE_SECONDS) -> DataFrame:
    """(job_id, status) of jobs to be queued again, from a stream (job_id, status, updated_at)."""
    return log.groupBy("job_id").transformWithStateInPandas(Requeue(seconds), "job_id string, status string", "Append", "processingTime")
