"""What the plans must and must not contain."""

import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from palindra import session
from palindra.functions import text as txt
from palindra.operators import ordered, packing, vocabulary
from palindra.operators.ordered import Running
from palindra.operators.packing import PackSettings
from palindra.plans import corpus, queries
from palindra.sources import shards
from tests import own_tables

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_only_needed_columns_are_read(spark):
    read = re.findall("ReadSchema: (.*)", plan(queries.reverse_layout_counts(spark, SF_DIR)))
    assert read == ["struct<doc_id:bigint,text:string,lang:string,source:string>"]
    listing = plan(queries.checkpoints(spark, SF_DIR))
    assert "o_orderdate" in listing and "Window" not in listing


def test_running_windows_are_bounded_by_chunks(spark, monkeypatch):
    log = queries.run_log(spark, SF_DIR)
    seen = plan(ordered.running(log, ["run_id"], ["seq"], [Running("sum", F.col("tokens"), "t")]))
    windows = re.findall(r"\bArguments: \[[^\n]*windowspecdefinition\(([^\n]*)", seen)
    assert windows and all("_c0" in w or "attempt" in w or "_before" in w or "run_id" in w for w in windows)
    keys = re.findall(r"hashpartitioning\(([^\n]*?), \d+\)", seen)
    assert any("_c0" in k for k in keys)


def test_lookup_needs_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    words = vocabulary.build(vocabulary.count_tokens(docs.select(txt.tokens(F.col("text")).alias("tokens"))))
    assert "Exchange" not in plan(vocabulary.encode_texts(docs, words))


def test_written_blocks_are_found_by_statistics(spark, tmp_path):
    settings = PackSettings(60_000, Fraction(1, 4), 3_000, shard_tokens=20_000, block_size=64)
    docs, turns = own_tables.documents(spark, 900), own_tables.conversations(spark, 900)
    built = corpus.build(docs, turns, settings, corpus.words_of(docs, turns))
    shards.write_blocks(built.blocks(), str(tmp_path / "corpus"))
    read = shards.read_blocks(spark, str(tmp_path / "corpus"), "train").where("block_idx between 10 and 12")
    shown = plan(read)
    assert re.search(r"PartitionFilters: \[.*split.*train", shown)
    assert "GreaterThanOrEqual(block_idx,10)" in shown
    assert [r.block_idx for r in read.orderBy("block_idx").collect()] == [10, 11, 12]
    everything = spark.read.parquet(str(tmp_path / "corpus"))
    table = built.shards.agg(F.sum("blocks")).first()[0]
    assert everything.count() == table and everything.where(F.size("tokens") != 65).count() == 0
    assert packing.totals(built.counts()).first().total_tokens >= 60_000


class Named:
    """A session that only has settings."""

    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        assert not key.startswith("spark."), "Spark's own settings cannot be changed"
        self.settings[key] = value


def test_shared_folder():
    assert session.shared_dir(Named(spark_checkpoint_dir="hdfs:/c/", palindra_shared_dir="x")) == "hdfs:/c"
    assert session.shared_dir(Named(spark_master="spark://a", palindra_shared_dir="hdfs:/s")) == "hdfs:/s"
    for master in ("spark://a:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            session.shared_dir(Named(spark_master=master))
    own = Named(spark_master="local[2]")
    assert session.shared_dir(own) == session.shared_dir(own)
