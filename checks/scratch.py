"""Scratch folders of the checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="fieldtempo-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder the session gives in ``spark.checkpoint.dir``.

    Only a local session may do without that setting: its executors share this machine's disk. All
    its scratch folders lie in one, which goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=64)
def _kept(application: str, name: str, sf_dir: str) -> str:
    return uuid.uuid4().hex


def kept_path(spark: SparkSession, name: str, sf_dir: str) -> tuple[str, bool]:
    """A folder that stays the same for a session and its input, and whether it is finished."""
    unique = _kept(spark.sparkContext.applicationId, name, sf_dir)
    path = scratch_path(spark, name).rsplit("-", 1)[0] + f"-{unique}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_FINISHED")
    files = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path, files.exists(mark)


def finish(spark: SparkSession, path: str) -> None:
    spark.range(1).write.mode("overwrite").parquet(f"{path}/_FINISHED")
