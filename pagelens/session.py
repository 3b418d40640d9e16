"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a side may be broadcast after counting it.
BROADCAST_ROWS = 20_000


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which executors share.

    Only where the setting is absent (tests, one machine) a temporary folder stands in.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), "pagelens-checkpoints")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


_WRITTEN: list[tuple] = []  # file system and path of each table
#: Delete what an execution shuffled as soon as it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    The lineage is cut, so a lost executor costs no recomputation; the table is
    compressed, readers take the columns they need and the planner knows its true
    size.  :func:`release` deletes such tables, the end of the process does so too.  The
    files shuffled for it are deleted at once: the disk holds those of one table at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((at.getFileSystem(spark._jsc.hadoopConfiguration()), at))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables written so far; frames that read them cannot be used afterwards."""
    while _WRITTEN:
        files, at = _WRITTEN.pop()
        try:
            files.delete(at, True)
        except Exception:  # the JVM is gone, and with it the access to the folder
            return


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


OPEN_COST = 4 << 20  # bytes under which Spark does not split a file


def dealt(df: DataFrame) -> DataFrame:
    """A frame that costs much a row: where a table has fewer files than half the cores
    and is too small to be split among them, its rows are dealt out to all cores.

    Larger tables are left as they are, so at scale there is no shuffle.  Only the plan
    is looked at.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not 0 < size < cores * OPEN_COST:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores / 2 else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows
