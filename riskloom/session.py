"""Session helpers: local settings for tests and benches, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", name: str = "riskloom") -> SparkSession:
    """A local session. On a cluster the submitting tool sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path in the folder all executors share.

    The cluster names that folder in `spark.checkpoint.dir` (or by `setCheckpointDir`). Only a
    local session may do without: a temporary folder of this machine, removed at exit, stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or _set_on_context(spark) or _local_folder(spark)
    return f"{base.rstrip('/')}/riskloom/{purpose}-{uuid.uuid4().hex}"


def _set_on_context(spark: SparkSession) -> str:
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return folder.get() if folder.isDefined() else ""


_LOCAL: list[tempfile.TemporaryDirectory] = []


def _local_folder(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="riskloom-"))
    return _LOCAL[0].name


#: Rows of a costly scan in one task.
SPREAD_ROWS = 100_000


def spread(scan: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """A table scan with at least as many partitions as there are cores, and as its rows ask for.

    One small file is one task however much work each of its rows is, and a compact file
    is few tasks however many rows it has. Input cut finely enough is left as it is, and no shuffle is added.
    `counted` has as many rows and is cheaper to count, as a bare table is.
    """
    parts = scan.rdd.getNumPartitions()
    cores = scan.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-(scan if counted is None else counted).count() // SPREAD_ROWS))
    return scan if parts >= wanted else scan.repartition(wanted)
