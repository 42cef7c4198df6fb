"""Analytics over step and epoch logs of training runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.functions.schedules import learning_rate, warmup_progress

UNREACHED_LOSS = 1e10


def epoch_losses(steps: DataFrame, planned_steps: int | None = None) -> DataFrame:
    """Mean step loss per run and epoch: a failed step counts as infinite, a missing one as 1e10."""
    loss = F.when(F.col("failed"), F.lit(math.inf)).otherwise(F.col("loss"))
    sums = steps.groupBy("run", "epoch").agg(F.sum(loss).alias("total"), F.count("*").alias("steps"))
    planned = F.col("steps") if planned_steps is None else F.greatest(F.col("steps"), F.lit(planned_steps))
    mean = (F.col("total") + (planned - F.col("steps")) * UNREACHED_LOSS) / planned
    return sums.select("run", "epoch", "steps", mean.alias("train_loss"))


def best_epochs(epochs: DataFrame) -> DataFrame:
    """Epoch with the lowest validation loss per run, the first one on a tie; null if no loss is known.

    A loss that is null or not a number is no loss.
    """
    known = F.when(~F.isnan("val_loss"), F.col("val_loss"))
    return epochs.groupBy("run").agg(
        F.min_by("epoch", F.when(known.isNotNull(), F.struct("val_loss", "epoch"))).alias("best_epoch"), F.min(known).alias("best_loss")
    )


def running_best(epochs: DataFrame) -> DataFrame:
    """Best validation loss up to each epoch, and whether the epoch set it."""
    past = Window.partitionBy("run").orderBy("epoch")
    known = F.when(~F.isnan("val_loss"), F.col("val_loss"))
    before = F.min(known).over(past.rowsBetween(Window.unboundedPreceding, -1))
    best = F.min(known).over(past.rowsBetween(Window.unboundedPreceding, 0))
    return epochs.withColumns({
        "best_so_far": best, "is_new_best": known.isNotNull() & (before.isNull() | (known < before)),
    })


def early_stops(epochs: DataFrame, patience: int = 10, min_delta: float = 0.0) -> DataFrame:
    """Epoch at which a run stops, its best loss and the misses counted by then.

    A loss lower than the best by more than ``min_delta`` resets the count; losses that
    are not finite change nothing. Epochs of a run are few, so the fold is one array.
    """
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(0).alias("misses"), F.lit(None).cast("bigint").alias("stopped")
    )

    def step(state, row):
        loss = row["loss"]
        finite = loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) != math.inf)
        skip = state["stopped"].isNotNull() | ~F.coalesce(finite, F.lit(False))
        first = state["best"].isNull()
        better = first | (loss < state["best"] - min_delta)
        misses = F.when(skip | first, state["misses"]).when(better, 0).otherwise(state["misses"] + 1)
        return F.struct(
            F.when(~skip & better, loss).otherwise(state["best"]).alias("best"),
            misses.alias("misses"),
            F.when(~skip & ~first & (misses >= patience), row["epoch"]).otherwise(state["stopped"]).alias("stopped"),
        )

    history = F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("bigint").alias("epoch"), F.col("val_loss").alias("loss"))))
    folded = epochs.groupBy("run").agg(history.alias("history")).select("run", F.aggregate("history", start, step).alias("s"))
    return folded.select(
        "run", F.col("s.stopped").alias("stop_epoch"), F.col("s.best").alias("best_loss"), F.col("s.misses").alias("misses")
    )


def epoch_records(steps: DataFrame, validation: DataFrame) -> DataFrame:
    """Training loss, validation figures, duration and best loss so far, per run and epoch."""
    timed = steps.groupBy("run", "epoch").agg(
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6).alias("epoch_seconds")
    )
    rows = epoch_losses(steps).join(timed, ["run", "epoch"]).join(validation, ["run", "epoch"])
    return running_best(rows)


def step_records(steps: DataFrame, warmup_steps: int, total_steps: int, base_rate: float = 1e-4) -> DataFrame:
    """Loss, learning rate and warm-up progress of every step."""
    warmup, total = F.lit(warmup_steps), F.lit(total_steps)
    return steps.select(
        "run", "epoch", "step", "loss",
        learning_rate(F.col("step"), warmup, total, base_rate).alias("learning_rate"),
        warmup_progress(F.col("step"), warmup).alias("warmup_progress"),
    )
