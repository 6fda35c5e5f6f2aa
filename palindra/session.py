"""Session settings and the shared folder for data that must outlive a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHARED_KEY = "palindra.shared.dir"


def local_session(cores: str | int = 8, app: str = "palindra", memory: str = "16g") -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``, or in ``palindra.shared.dir`` where
    that is unset. Only a local session without either, as in tests, gets a fresh
    temporary folder; on a cluster that would be a folder of one machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get(SHARED_KEY, None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} or {SHARED_KEY} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="palindra-shared-")
        spark.conf.set(SHARED_KEY, named)
    return named.rstrip("/")


# Input that may be moved once so that every core gets a part of it.
SMALL_INPUT = 1 << 30


def estimated_bytes(df: DataFrame) -> int:
    """Size of everything ``df`` reads: file sizes of its tables, whole.

    Estimates further up the plan scale with column counts and would take a table
    of long texts for a small one. What is not a file or a local table, such as a
    micro-batch, counts as unbounded.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Place a small table by ``key`` so that its tokenising uses all cores.

    A small file is often a single row group, which one task reads. Beyond
    ``SMALL_INPUT`` bytes of files a table has row groups
    enough and is left where it lies: there the shuffle would cost more than it
    gives.
    """
    if estimated_bytes(df) > SMALL_INPUT:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/palindra/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches or where row placement must not
    change when a lost executor forces a recomputation. Parquet rather than an
    RDD checkpoint, so that later branches still prune columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
