"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"

#: A table of at most this many rows of a few numbers (some MB) is broadcast.
BROADCAST_ROWS = 100_000


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="llm-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a temporary one,
    which goes when the process ends."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder every executor can reach")
        folder = _local_folder()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again: a lost executor costs no
    more than the tasks it ran. The table stays until the folder is cleaned."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint, if the counted rows are few enough."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names that clash with none of those taken, whatever their case."""
    lower = {name.lower() for name in taken}
    names = []
    for name in wanted:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        names.append(name)
    return names
