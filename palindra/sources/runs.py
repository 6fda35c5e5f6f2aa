"""Files a training run leaves behind: log, status, samples, checkpoints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.session import stage

# The columns of a run log.
LOG_FIELDS = [
    "step", "wall_s", "tokens", "lr", "loss", "loss_ema", "val_loss", "grad_norm", "scale", "tok_per_s", "phase",
]
LOG_SCHEMA = """step bigint, wall_s double, tokens bigint, lr double, loss double, loss_ema double,
val_loss double, grad_norm double, scale double, tok_per_s double, phase string"""
STATUS_SCHEMA = """run_id string, step bigint, tokens_seen bigint, loss double, loss_ema double,
val_loss double, best_val double, lr double, tok_per_s double, secs_per_step double, phase string,
decay_start bigint, decay_steps bigint, max_steps bigint, elapsed_s double, remaining_s double,
epoch double, world_size bigint, tokens_per_step bigint, last_save_step bigint, saving boolean,
alive boolean, stop_reason string, heartbeat double"""


def _matches(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _folder_below(pattern: str) -> Column:
    """The folder of a file as seen from the folders that ``pattern`` fixes; its own name
    where the pattern leaves nothing open. So runs in folders of one name stay apart."""
    folder = F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]+$", 1)
    own = F.regexp_extract(folder, r"([^/]+)$", 1)
    fixed = re.match(r"[^*?\[{]*/", pattern)
    if fixed is None or not re.search(r"[*?\[{]", pattern):
        return own
    root = re.sub(r"^\w+:(//[^/]*)?", "", fixed[0]).rstrip("/") + "/"
    below = F.substring_index(F.concat(folder, F.lit("/")), root, -1)
    return F.coalesce(F.nullif(F.rtrim(below, F.lit("/")), F.lit("")), own)


def read_log(spark: SparkSession, pattern: str) -> DataFrame:
    """Log rows of many runs with ``run_id`` (the folder's path below what the pattern
    fixes) and ``seq``, the file order.

    ``seq`` is the split's byte offset plus the row's place in the split; a row
    takes at least a byte, so it rises through the file. No file gives no rows.
    """
    if not _matches(spark, pattern):
        return spark.createDataFrame([], f"{LOG_SCHEMA}, run_id string, seq bigint")
    rows = (
        spark.read.schema(LOG_SCHEMA)
        .option("header", "true")
        .option("nullValue", "")
        .csv(pattern)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            _folder_below(pattern).alias("run_id"),
            F.col("_metadata.file_block_start").alias("_begin"),
            F.monotonically_increasing_id().alias("_id"),
        )
    )
    firsts = rows.groupBy("_file", "_begin").agg(F.min("_id").alias("_first"))
    return rows.join(firsts, ["_file", "_begin"]).select(
        *LOG_FIELDS,
        "run_id",
        (F.col("_begin") + F.col("_id") - F.col("_first")).alias("seq"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows; other columns are left out, missing ones stay blank."""
    have = set(rows.columns)
    columns = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in LOG_FIELDS]
    rows.select(*columns).write.mode("append").option("header", "true").option("nullValue", "").csv(path)


def read_status(spark: SparkSession, pattern: str) -> DataFrame:
    """Status snapshots; a file that is not JSON counts as absent."""
    if not _matches(spark, pattern):
        return spark.createDataFrame([], f"{STATUS_SCHEMA}, path string")
    raw = spark.read.text(pattern, wholetext=True)
    parsed = raw.select(
        _folder_below(pattern).alias("folder"),
        F.col("_metadata.file_path").alias("path"),
        F.from_json(
            "value", STATUS_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}
        ).alias("s"),
    ).where(F.col("s").isNotNull() & F.col("s._bad").isNull())
    return parsed.withColumn(
        "s", F.col("s").withField("run_id", F.coalesce("s.run_id", "folder")).dropFields("_bad")
    ).select("s.*", "path")


def stamped(status: DataFrame) -> DataFrame:
    """Status rows with the heartbeat of this moment."""
    return status.withColumn("heartbeat", F.unix_micros(F.current_timestamp()) / 1e6)


def write_status(status: DataFrame, path: str) -> None:
    """Replace the rows of these runs in the status table at ``path``, a JSON object per run,
    and stamp them with this moment; other runs stay as they are."""
    spark = status.sparkSession
    now = stamped(status)
    if _matches(spark, path):
        others = read_status_table(spark, path).join(now.select("run_id"), "run_id", "left_anti")
        now = now.unionByName(others, allowMissingColumns=True)
    stage(now, "status").write.mode("overwrite").json(path)


def read_status_table(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_status`` left; lines that are not JSON drop out."""
    return spark.read.schema(STATUS_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def list_checkpoints(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, length, mtime) of checkpoint files at most three folders below a root.

    Only the listing is read: file contents are pruned. Folders are no files, and
    a file below two of the roots is listed once.
    """
    listed = None
    for root in roots:
        base = root.rstrip("/")
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.pt")
            .option("recursiveFileLookup", "true")
            .load(base)
            .select("path", "length", F.unix_micros("modificationTime").alias("mtime"))
        )
        beyond = F.substring_index(F.col("path"), base + "/", -1)
        near = files.where(F.size(F.split(beyond, "/")) <= 4)
        listed = near if listed is None else listed.unionByName(near)
    return listed.dropDuplicates(["path"])


def read_samples(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, step, loss, text) of sample lines ``step N<TAB>loss X<TAB>text``."""
    parts = F.split("value", "\t", 3)
    return (
        spark.read.text(pattern)
        .select(F.col("_metadata.file_path").alias("path"), parts.alias("p"))
        .where(F.size("p") == 3)
        .select(
            "path",
            F.regexp_extract(F.col("p")[0], "([0-9]+)$", 1).try_cast("bigint").alias("step"),
            F.substring_index(F.col("p")[1], " ", -1).try_cast("double").alias("loss"),
            F.col("p")[2].alias("text"),
        )
    )
