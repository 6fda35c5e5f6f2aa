"""Learning-rate schedule and run arithmetic as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    # The schedule's defaults.
    lr: float = 1e-4
    min_lr: float = 1e-5
    warmup_steps: int = 200
    decay_steps: int = 1500


def _flat(step: Column, decay_start: Column) -> Column:
    return decay_start.isNull() | (step < decay_start)


def learning_rate(step: Column, decay_start: Column, s: Schedule) -> Column:
    """Linear warm-up, flat, then one minus square root down to ``min_lr``."""
    done = F.least(F.lit(1.0), (step - decay_start) / F.lit(max(1, s.decay_steps)))
    return (
        F.when(step < s.warmup_steps, F.lit(s.lr) * (step + 1) / F.lit(max(1, s.warmup_steps)))
        .when(_flat(step, decay_start), F.lit(s.lr))
        .otherwise(F.lit(s.min_lr) + F.lit(s.lr - s.min_lr) * (F.lit(1.0) - F.sqrt(done)))
    )


def phase(step: Column, decay_start: Column, s: Schedule) -> Column:
    return (
        F.when(step < s.warmup_steps, "warmup")
        .when(_flat(step, decay_start), "constant")
        .when(step < decay_start + s.decay_steps, "decay")
        .otherwise("done")
    )


def snapped_rate(step: Column, decay_start: Column, s: Schedule, buckets: int = 32) -> Column:
    """The rate on a grid of ``lr / buckets``, ties to even."""
    rate = learning_rate(step, decay_start, s)
    if s.lr <= 0:
        return rate
    grid = s.lr / buckets
    return F.bround(rate / F.lit(grid)) * F.lit(grid)


def tokens_per_step(micro_batch: Column, grad_accum: Column, world: Column, block_size: Column) -> Column:
    return micro_batch * grad_accum * world * block_size


def epoch_at(step: Column, per_step_blocks: Column, n_blocks: Column) -> Column:
    return step * per_step_blocks / F.greatest(F.lit(1), n_blocks)


def rate(amount: Column, seconds: Column) -> Column:
    return amount / F.greatest(F.lit(1e-6), seconds)


def eta_seconds(target: Column, tokens: Column, per_second: Column) -> Column:
    """Time to the target; unknown where the rate is."""
    return F.when(per_second.isNotNull(), (target - tokens) / F.greatest(F.lit(1.0), per_second))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(F.lit(20.0), loss))


def token_dtype(vocab_size: Column) -> Column:
    return F.when(vocab_size <= 65535, "uint16").otherwise("uint32")


def bytes_per_token(vocab_size: Column) -> Column:
    return F.when(vocab_size <= 65535, 2).otherwise(4)


def session_tokens(hours: Column, tok_per_s: Column) -> Column:
    return hours * 3600 * tok_per_s


def train_hours(hours: Column) -> Column:
    return F.greatest(F.lit(0.4), hours - 0.45)


def planned_decay_steps(hours: Column) -> Column:
    return F.greatest(F.lit(200), (train_hours(hours) * 120).cast("int"))


def milestone_minutes(hours: Column) -> Column:
    return F.greatest(F.lit(15), (train_hours(hours) * 60 / 8).cast("int"))


def disk_gb_needed(planned_tokens: Column, written_tokens: Column, token_bytes: Column) -> Column:
    """Space still to be written, plus 8 GB for checkpoints."""
    return F.greatest(F.lit(0.0), (planned_tokens - written_tokens) * token_bytes / 1e9) + 8
