"""Folders for what a stage writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[str] = []


def work_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``; in local mode one that goes with the process, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _made:
            _made.append(tempfile.mkdtemp(prefix="tracemill-work-"))
        base = "file://" + _made[0]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@atexit.register
def _clear() -> None:
    for folder in _made:
        shutil.rmtree(folder, ignore_errors=True)
