"""Micro-batches of a job, pull sources, event-time windows and state tables."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.plans.job import Job


def run_stream(job: Job, stream: DataFrame, checkpoint: str, period: str | None = None, state: StateTable | None = None) -> StreamingQuery:
    """Each micro-batch goes through the job and its sink, as one run would.

    Folds and windows of a job begin anew with each batch.  Without a period all
    that is there is processed and the stream ends; with one it is polled until
    the query is stopped.  Offsets lie in the checkpoint, so a stream that is
    started again goes on where it was; a batch that is repeated after a failure
    gives the same rows and is written once: inserts into files carry the batch's name.
    """
    stream_name = hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def one(batch: DataFrame, number: int) -> None:
        status = job.run(batch, batch=f"{stream_name}-{number}")
        if state is not None:
            state.put({"batch": number} | {k: v for k, v in status.items() if isinstance(v, (int, str))})

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)
    return writer.start()


def tumbling(stream: DataFrame, time: str, size: str, keys: list[str], aggregates: dict[str, Any], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates by event-time windows, with rows accepted until ``late`` after the latest time seen."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = stream.withWatermark(time, late).groupBy(window.alias("w"), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("window_start"), *keys, *aggregates)


class StateTable:
    """A small key-value table of a job's cursor and counters, kept as JSON beside the checkpoint."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _file(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def get(self) -> dict[str, str]:
        path, fs = self._file()
        if not fs.exists(path):
            return {}
        return {r["key"]: r["value"] for r in self.spark.read.json(self.path, schema="key string, value string").collect()}

    def put(self, values: dict[str, Any]) -> None:
        merged = self.get() | {k: str(v) for k, v in values.items()}
        rows = self.spark.createDataFrame(sorted(merged.items()), "key string, value string")
        rows.coalesce(1).write.mode("overwrite").json(self.path)
