"""Spark session defaults and the staging folder used to cut long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A scan of many named files looks each of them up, by default in a task of its own: a hundred tasks list any number.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "100",
    # A Python worker holds a few copies of a batch: rows of long texts are sent a few megabytes at a time.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # The JVM interprets methods above this size; wide JSON projections run faster in smaller compiled ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# Settings a running session no longer takes: call-site capture costs more than planning for wide expressions.
STARTUP_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

_LOCAL_ROOT: list[str] = []
_STAGED: list[str] = []


def build_session(master: str | None = None, app: str = "meterwork", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STARTUP_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_settings(spark: SparkSession) -> SparkSession:
    """Put the runtime settings the operators rely on (UTC day keys above all) on a given session.

    Python workers on this machine find the package wherever they start; a cluster needs it installed or in --py-files.
    """
    workers, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in workers.get("PYTHONPATH", "").split(os.pathsep):
        workers["PYTHONPATH"] = os.pathsep.join(filter(None, [root, workers.get("PYTHONPATH")]))
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """Folder shared by all executors; a local one is made only for local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="meterwork-"))
    return _LOCAL_ROOT[0]


def stage(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in folders of the columns ``by``, and read it back.

    Used where a result feeds several branches: the expensive part (JSON
    parsing, ordered scans) runs once, the branches read narrow columns, and a
    lost executor costs one task, not the whole lineage.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_mark() -> int:
    """How many tables this process has staged; give it to ``clear_staged`` to keep those."""
    return len(_STAGED)


def clear_staged(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables this process staged after ``since`` (their readers must be done); returns their number."""
    paths, _STAGED[since:] = _STAGED[since:], []
    for path in paths:
        remove(spark, path)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this process made, wherever it lies; one that is not there is no error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
