"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE sizes the small shuffles that follow the first one, so the partition count only has to be
# large enough for the first: per-enumerator-day counts of the whole input.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Recording the Python line of every Column call makes plans several times slower to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
}

# For ~1000 executors: scan splits of 512 MB keep the map side of 100 TB near 200,000 tasks. A task
# of a partitioned write holds few campaigns: open writers for them spare it a sort.
CLUSTER_CONF = {
    **BASE_CONF,
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.maxConcurrentOutputFileWriters": "32",
}

# The first shuffle holds a row per enumerator and day. Where few deliveries share one it is about as
# large as the columns in use, and adaptive execution can join partitions of an aggregate but never
# split them: so there are enough for that case, and the others end with fewer.
SHUFFLE_BYTES = 128 << 20
LEAST_PARTITIONS, MOST_PARTITIONS = 200, 200_000


def first_partitions(input_bytes: int) -> int:
    """Partitions of the first shuffle, if all of the input's bytes went through it."""
    return min(MOST_PARTITIONS, max(LEAST_PARTITIONS, -(-input_bytes // SHUFFLE_BYTES)))


def cluster_conf(input_bytes: int) -> dict[str, str]:
    """Settings for deliveries of that many bytes; Spark joins the small partitions again."""
    partitions = str(first_partitions(input_bytes))
    return {
        **CLUSTER_CONF,
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": partitions,
    }


def cluster_session(input_bytes: int, app: str = "fieldtempo", **conf: str) -> SparkSession:
    """A session for a cluster; the master comes from the environment that submits it."""
    settings = {**cluster_conf(input_bytes), **_named(conf)}
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _named(conf: dict[str, str]) -> dict[str, str]:
    return {key.replace("__", "."): value for key, value in conf.items()}


def local_session(cores: int | str = "*", app: str = "fieldtempo", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        "spark.driver.memory": "12g",
        **_named(conf),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

