"""Building a corpus in several runs, each with what has arrived by then.

A run leaves out the documents that earlier runs used, by id, and goes on where they
stopped: token offsets, the shard grid and the blocks continue as if all had been packed
at once. Validation is fixed by the first run. The row of ``progress`` is a run's
commit and is written last; a run without it is done again and replaces its own files,
and no reader sees them.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.operators import inventory, packing, vocabulary
from palindra.operators.packing import PackSettings
from palindra.plans import corpus
from palindra.session import stage
from palindra.sources import corpora

PROGRESS = "run int, settings string, source string, docs bigint, tokens bigint, val_docs bigint, val_tokens bigint"
USED = "run int, source string, doc bigint"
PARTS = "run int, split string, stream string, doc bigint, shard bigint, at bigint, tokens array<%s>"
WORDS = "run int, token string, id bigint"
COUNTS = ("docs", "tokens", "val_docs", "val_tokens")


@dataclass(frozen=True)
class ResumedBuild:
    """A corpus folder: ``used``, ``parts`` and ``progress``, each by run.

    With ``ids``, tokens are numbered: every run adds those that are new to ``words``,
    behind the ids that earlier runs gave.
    """

    folder: str
    settings: PackSettings
    ids: bool = False

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def progress(self, spark: SparkSession) -> DataFrame:
        """(run, settings, source, docs, tokens, val_docs, val_tokens) that each run added."""
        return self._read(spark, "progress", PROGRESS)

    def _committed(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        runs = [r.run for r in self.progress(spark).select("run").distinct().collect()]
        return self._read(spark, name, schema).where(F.col("run").isin(runs))

    def words(self, spark: SparkSession) -> DataFrame:
        """(token, id) of all runs."""
        added = self._committed(spark, "words", WORDS).select("token", "id")
        return vocabulary.special_tokens(spark).unionByName(added)

    def _numbered(self, pieces: DataFrame, number: int) -> DataFrame:
        known = self.words(pieces.sparkSession)
        path = f"{self.folder}/words/run={number}"
        vocabulary.additions(vocabulary.count_tokens(pieces), known).write.mode("overwrite").parquet(path)
        added = pieces.sparkSession.read.schema("token string, id bigint").parquet(path)
        return vocabulary.encode_arrays(pieces, ["source", "doc", "piece"], "tokens", known.unionByName(added))

    def used(self, spark: SparkSession) -> DataFrame:
        return self._committed(spark, "used", USED)

    def counts(self, spark: SparkSession) -> DataFrame:
        """(source, docs, tokens, val_docs, val_tokens) of all runs."""
        return self.progress(spark).groupBy("source").agg(*[F.sum(c).alias(c) for c in COUNTS])

    def is_complete(self, spark: SparkSession) -> bool:
        """Both sources reached their target and there is validation text."""
        counts = self.counts(spark)
        held = counts.agg(F.coalesce(F.sum("val_tokens"), F.lit(0))).first()[0]
        done = inventory.completeness(counts, self.settings.web_target, self.settings.chat_target, held > 0)
        return done.first().complete

    def run(self, documents: DataFrame, turns: DataFrame, number: int | None = None) -> bool:
        """Add what is new of ``documents`` and ``turns``; whether there was anything left to do.

        ``number`` is the run's place, the next one if it is not given. A run whose number
        is committed does nothing.
        """
        spark, settings = documents.sparkSession, self.settings
        plan = repr(sorted((k, str(v)) for k, v in asdict(settings).items()))
        before = self.progress(spark).select("run", "settings").distinct().collect()
        if any(r.settings != plan for r in before):
            raise ValueError(f"{self.folder} was begun with other settings")
        if before and self.is_complete(spark):
            return False
        if number is None:
            number = max((r.run for r in before), default=-1) + 1
        elif number in {r.run for r in before}:
            return True
        done = {r.source: r.tokens for r in self.counts(spark).collect()}
        left = {"web": settings.web_target - done.get("web", 0), "chat": settings.chat_target - done.get("chat", 0)}
        if before:
            used = self.used(spark)
            ids = {s: used.where(F.col("source") == s) for s in packing.SOURCES}
            documents = corpora.not_yet_used(documents, ids["web"].select(F.col("doc").alias("doc_id")))
            turns = corpora.not_yet_used(turns, ids["chat"].select(F.col("doc").alias("conv_id")), ["conv_id"])
            # A source that has reached its target is not read again.
            documents = documents if left["web"] > 0 else documents.where("false")
            turns = turns if left["chat"] > 0 else turns.where("false")
        pieces = corpus.laid_out(documents, turns, settings.direction)
        if self.ids:
            pieces = self._numbered(stage(pieces, "texts"), number)
        pieces = stage(pieces.withColumn("n", F.size("tokens").cast("bigint")), "pieces")
        spans = stage(packing.offsets(pieces), "spans")
        if before:
            cuts = packing.document_cut(spans, left)
            none = F.lit(0).cast("bigint")
            limits = stage(cuts.select("source", none.alias("val_end"), F.col("cut").alias("train_end")), "limits")
            held = None
        else:
            val, limits = packing.split_plan(spans, settings)
            held = packing.val_spans(spans, val, limits)
        train = packing.train_spans(spans, limits)
        offset = F.create_map(*[F.lit(x) for s in packing.SOURCES for x in (s, done.get(s, 0))])[F.col("source")]
        placed = train.withColumn("start", F.col("start") + offset)
        all_spans = stage(placed if held is None else placed.unionByName(held), "placed")
        parts = packing.place_tokens(pieces, all_spans, settings)
        parts.write.mode("overwrite").parquet(f"{self.folder}/parts/run={number}")
        all_spans.select("source", "doc").distinct().write.mode("overwrite").parquet(f"{self.folder}/used/run={number}")
        is_val = F.col("split") == "val"
        counted = all_spans.groupBy("source").agg(
            F.count_if(F.col("ends_doc") & ~is_val).alias("docs"),
            F.coalesce(F.sum(F.when(~is_val, F.col("n"))), F.lit(0)).alias("tokens"),
            F.count_if(F.col("ends_doc") & is_val).alias("val_docs"),
            F.coalesce(F.sum(F.when(is_val, F.col("n"))), F.lit(0)).alias("val_tokens"),
        )
        # Two rows at most, one file: it is there as a whole or not at all.
        rows = spark.createDataFrame([(s,) for s in packing.SOURCES], "source string").join(counted, "source", "left")
        rows.na.fill(0).withColumn("settings", F.lit(plan)).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/progress/run={number}"
        )
        return True

    def parts(self, spark: SparkSession) -> DataFrame:
        """(split, stream, doc, shard, at, tokens) of all runs."""
        return self._committed(spark, "parts", PARTS % ("bigint" if self.ids else "string")).drop("run")

    def shards(self, spark: SparkSession) -> DataFrame:
        counts = self.counts(spark)
        train = counts.select(F.lit("train").alias("split"), F.col("source").alias("stream"), F.col("tokens").alias("length"))
        held = counts.agg(F.coalesce(F.sum("val_tokens"), F.lit(0)).alias("length"))
        val = held.select(F.lit("val").alias("split"), F.lit("val").alias("stream"), "length")
        return packing.shards(train, self.settings).unionByName(
            packing.shards(val, packing.shard_lengths_for(self.settings, "val"))
        )

    def blocks(self, spark: SparkSession) -> DataFrame:
        return packing.blocks(self.parts(spark), self.shards(spark), self.settings.block_size)
