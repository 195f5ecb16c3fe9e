"""Incremental processing of trace files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nonblank
from ..sources.jsonl import strict, write_results


def follow_traces(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (value, m) over JSON-lines files that appear in a folder; blank lines are passed over."""
    lines = spark.readStream.schema("value string").text(folder)
    return lines.where(nonblank(F.col("value"))).select("value", strict(F.col("value")).alias("m"))


def process_as_they_come(stream: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True):
    """Run ``work`` on each micro-batch and add its successful rows; the checkpoint resumes where a run stopped.

    Each micro-batch has a folder of its own, so one that is replayed after a failure replaces what it had written.
    """

    def batch(df: DataFrame, number: int) -> None:
        write_results(work(df), f"{output.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
