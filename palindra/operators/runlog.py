"""Training-run logs: one row per logged step, keyed by run, ordered by ``seq``.

``seq`` is the row's place in its log, a unique BIGINT per run. Nothing here
windows over a whole run: earlier rows are seen through ``running``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palindra.functions import schedule
from palindra.operators.ordered import (
    Running,
    affine,
    attach,
    attach_totals,
    newest,
    running,
    upper_median,
)
from palindra.session import stage

RUN = ["run_id"]

PARTS = 64

# Rows of a chunk of the moving average, at most.
MOST_CHUNK = 4096


def spread() -> Column:
    """Splits one run's rows into parts where a per-run value joins them."""
    return F.pmod(F.shiftright("seq", 4), F.lit(PARTS))


# Smoothing of the loss, seconds until a heartbeat is stale, the
# least acceptable jump at a restart and how many times the noise is acceptable.
EMA_KEEP = 0.9
STALE_SECONDS = 180
TOLERANCE = 0.05
NOISE_FACTOR = 4


def with_previous(log: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Add ``prev``, a struct of the row before; null on the first row."""
    row = F.struct(*columns)
    return running(log, list(keys), ["seq"], [Running("last", row, "prev")])


def restarts(log: DataFrame) -> DataFrame:
    """Add prev, ``restart`` (the clock fell back) and ``stalled`` (the step did not rise)."""
    seen = with_previous(log, ["step", "wall_s", "loss"])
    zero = F.lit(0.0)
    back = F.coalesce("wall_s", zero) < F.coalesce("prev.wall_s", zero)
    return seen.withColumn("restart", F.col("prev").isNotNull() & back).withColumn(
        "stalled", F.col("prev").isNotNull() & (F.col("step") <= F.col("prev.step"))
    )


def attempts(log: DataFrame) -> DataFrame:
    """Add ``session``: how many restarts precede or begin at the row."""
    marked = restarts(log)
    hit = F.col("restart").cast("bigint")
    return running(marked, RUN, ["seq"], [Running("sum", hit, "_earlier")]).select(
        *log.columns, (F.col("_earlier") + hit).alias("session")
    )


def noise(marked: DataFrame) -> DataFrame:
    """(run_id, noise): upper median of absolute finite loss steps away from restarts."""
    steps = marked.where(F.col("prev").isNotNull() & ~F.col("restart")).select(
        "run_id", F.abs(F.col("loss") - F.col("prev.loss")).alias("step_size")
    )
    return upper_median(steps.where(finite(F.col("step_size"))), RUN, "step_size", "noise")


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def restart_verdicts(log: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """A row per restart: step gap, loss jump, the run's limit and the verdict.

    A rise up to the limit passes and so does any fall; a missing, infinite or undefined
    loss on either side does not.
    """
    marked = restarts(log)
    found = marked.where("restart")
    limited = attach(found, RUN, spread(), F.lit(PARTS), noise(marked), "left")
    limit = F.greatest(F.lit(tolerance), NOISE_FACTOR * F.coalesce("noise", F.lit(0.0)))
    delta = F.col("loss") - F.col("prev.loss")
    gap = F.col("step") - F.col("prev.step")
    return limited.select(
        "run_id",
        "seq",
        F.col("prev.step").alias("from_step"),
        "step",
        gap.alias("step_gap"),
        delta.alias("delta"),
        limit.alias("limit"),
        ((gap > 0) & F.coalesce(finite(delta) & (delta <= limit), F.lit(False))).alias("ok"),
    )


def restart_summary(log: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """A row per run: log extent, restarts and how many of them are bad."""
    extent = log.groupBy("run_id").agg(
        F.count("*").alias("log_rows"),
        F.min_by("step", "seq").alias("first_step"),
        F.max_by("step", "seq").alias("last_step"),
    )
    verdicts = restart_verdicts(log, tolerance).groupBy("run_id").agg(
        F.count("*").alias("restarts"), F.count_if(~F.col("ok")).alias("bad")
    )
    return extent.join(verdicts, "run_id", "left").na.fill(0, ["restarts", "bad"])


def smoothed_loss(log: DataFrame, keep: float = EMA_KEEP, name: str = "ema") -> DataFrame:
    """Exponential moving average of ``loss`` over a run; the first loss seeds it.

    Losses are numbered per run and cut into chunks. Inside a chunk the average is a
    closed-form window sum; a chunk as a whole maps what it starts from to where it ends,
    and these maps are composed along the run. Nothing is cut off, so an
    infinite or undefined loss stays in the average. Missing losses take no part and
    get null.
    """
    chunk = max(1, min(MOST_CHUNK, math.ceil(200 * math.log(2) / -math.log(keep))))
    present = F.col("loss").isNotNull()
    counted = running(log, RUN, ["seq"], [Running("sum", present.cast("bigint"), "_i")])
    numbered = counted.where(present).select(
        *log.columns,
        (F.col("_i") == 0).alias("_first"),
        F.expr(f"_i div {chunk}").alias("_chunk"),
        F.expr(f"_i % {chunk}").alias("_at"),
    )
    weight = F.when(F.col("_first"), 1.0).otherwise(1.0 - keep)
    upto = Window.partitionBy("run_id", "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    scaled = weight * F.col("loss") * F.pow(F.lit(keep), -F.col("_at"))
    local = numbered.withColumn("_local", F.sum(scaled).over(upto) * F.pow(F.lit(keep), F.col("_at")))
    ends = numbered.groupBy("run_id", "_chunk").agg(
        (F.sum(scaled) * F.pow(F.lit(keep), F.max("_at"))).alias("end"), (F.max("_at") + 1).cast("double").alias("n")
    )
    carries = affine(ends, RUN, "_chunk", F.pow(F.lit(keep), F.col("n")), F.col("end"), "_carry").select(
        "run_id", "_chunk", "_carry"
    )
    carried = F.when(F.col("_chunk") > 0, F.col("_carry") * F.pow(F.lit(keep), F.col("_at") + 1)).otherwise(0.0)
    smoothed = local.join(carries, ["run_id", "_chunk"], "left").select(
        *log.columns, (F.col("_local") + carried).alias(name)
    )
    blank = log.where(~present).withColumn(name, F.lit(None).cast("double"))
    return smoothed.unionByName(blank)


def throughput(log: DataFrame, tokens_per_step: int) -> DataFrame:
    """Add secs_per_step and tok_per_s since the attempt's previous row, else null."""
    seen = with_previous(log, ["step", "wall_s"], ["run_id", "attempt"])
    seconds = F.greatest(F.lit(1e-6), F.col("wall_s") - F.col("prev.wall_s"))
    steps = F.greatest(F.lit(1), F.col("step") - F.col("prev.step"))
    known = F.col("prev").isNotNull()
    return seen.select(
        *log.columns,
        F.when(known, seconds / steps).alias("secs_per_step"),
        F.when(known, steps * tokens_per_step / seconds).alias("tok_per_s"),
    )


def with_evaluations(log: DataFrame, evals: DataFrame) -> DataFrame:
    """As-of join: add the latest ``val_loss`` of the attempt and the run's best.

    A row is logged before the evaluation of its own step, so it sees strictly
    earlier ones. A restart blanks the latest value and keeps the best.
    """
    lines = log.select("*", F.lit(None).cast("double").alias("_val"), F.lit(True).alias("_is_log"))
    marks = evals.select("run_id", "attempt", "seq", F.col("val_loss").alias("_val"), F.lit(False).alias("_is_log"))
    both = lines.unionByName(marks, allowMissingColumns=True).withColumn(
        "_tick", F.col("seq") * 2 + F.when(F.col("_is_log"), 0).otherwise(1)
    )
    latest = running(both, ["run_id", "attempt"], ["_tick"], [Running("last", F.col("_val"), "val_loss")])
    best = running(latest, RUN, ["_tick"], [Running("min", F.col("_val"), "best_val")])
    return best.where("_is_log").select(*log.columns, "val_loss", "best_val")


def best_validation(evals: DataFrame) -> DataFrame:
    return evals.groupBy("run_id").agg(F.min("val_loss").alias("best_val"))


def recent(log: DataFrame, steps: int) -> DataFrame:
    """Rows within ``steps`` of the run's last step; all of them when it is 0."""
    if steps <= 0:
        return log
    ended = attach_totals(log, RUN, spread(), {"_last": F.max_by("step", "seq")})
    return ended.where(F.col("step") >= F.col("_last") - steps).select(*log.columns)


def chart_bins(log: DataFrame, series: Sequence[str], width: int = 72, height: int = 16) -> DataFrame:
    """(run_id, series, col, avg, row): each series averaged into chart columns.

    All series of a run share one frame, from the points that are present.
    """
    points = (
        log.select("run_id", "seq", "step", *series)
        .unpivot(["run_id", "seq", "step"], list(series), "series", "y")
        .where(F.col("y").isNotNull())
    )
    framed = attach_totals(
        points,
        RUN,
        spread(),
        {"xlo": F.min("step"), "xhi": F.max("step"), "ylo": F.min("y"), "yhi": F.max("y")},
    )
    span = F.greatest(F.lit(1e-9), F.col("xhi") - F.col("xlo"))
    place = ((F.col("step") - F.col("xlo")) / span * (width - 1)).cast("int")
    top = F.when(F.col("yhi") - F.col("ylo") < 1e-9, F.col("ylo") + 1e-9).otherwise(F.col("yhi"))
    means = (
        framed.withColumn("col", F.least(F.lit(width - 1), place))
        .groupBy("run_id", "series", "col")
        .agg(F.avg("y").alias("avg"), F.first(top).alias("_top"), F.first("ylo").alias("_low"))
    )
    row = F.bround((F.col("_top") - F.col("avg")) / (F.col("_top") - F.col("_low")) * (height - 1)).cast("int")
    return means.select(
        "run_id", "series", "col", "avg", F.greatest(F.lit(0), F.least(F.lit(height - 1), row)).alias("row")
    )


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of every run, ``rank`` 1 being the newest."""
    return newest(log, RUN, [F.desc("seq")], n, spread())


def latest(log: DataFrame) -> DataFrame:
    """The newest row of every run."""
    return log.groupBy("run_id").agg(F.max_by(F.struct(*log.columns), "seq").alias("r")).select("r.*")


def final_loss(log: DataFrame) -> DataFrame:
    """(run_id, step, loss_ema) of the run's last row."""
    return log.groupBy("run_id").agg(
        F.max_by("step", "seq").alias("step"), F.max_by("loss_ema", "seq").alias("loss_ema")
    )


def liveness(status: DataFrame, now: Column) -> DataFrame:
    """Add ``stale_s``, ``state`` and the coarser ``board_state``."""
    quiet = now - F.col("heartbeat")
    fresh = F.col("alive") & (quiet < STALE_SECONDS)
    done = F.coalesce("stop_reason", F.lit("")) != ""
    return status.withColumn("stale_s", quiet).select(
        "*",
        F.when(done, F.concat(F.lit("finished ("), F.col("stop_reason"), F.lit(")")))
        .when(fresh & F.col("saving"), "training (checkpointing)")
        .when(fresh, "training")
        .when(F.col("alive"), "quiet")
        .otherwise("stopped")
        .alias("state"),
        F.when(fresh, "training").when(done, "finished").otherwise("stalled").alias("board_state"),
    )


def scheduled(log: DataFrame, s: schedule.Schedule) -> DataFrame:
    """Add what the schedule prescribes at each row; needs ``decay_start``."""
    at = (F.col("step"), F.col("decay_start"), s)
    return log.select(
        "*",
        schedule.learning_rate(*at).alias("planned_lr"),
        schedule.snapped_rate(*at).alias("snapped_lr"),
        schedule.phase(*at).alias("planned_phase"),
    )


def mean_of_batch_means(metrics: DataFrame, group: Sequence[str], batch: Sequence[str], value: str) -> DataFrame:
    """Average of per-batch averages."""
    per_batch = metrics.groupBy(*group, *batch).agg(F.avg(value).alias("_mean"))
    return per_batch.groupBy(*group).agg(F.avg("_mean").alias(value))
