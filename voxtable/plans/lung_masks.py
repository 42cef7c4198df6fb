"""Mask generation: only unfinished cases, all of them in one plan, with per-case outcome."""

from __future__ import annotations

import time
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from voxtable.operators.lung_mask import region_masks, segment_lungs
from voxtable.operators.regions import lung_statistics
from voxtable.session import written
from voxtable.sources.catalog import unfinished_cases
from voxtable.sources.sinks import write_masks


class MaskRun(NamedTuple):
    masks: DataFrame
    outcomes: DataFrame


def generate_masks(voxels: DataFrame, cases: DataFrame, existing: DataFrame, **segmentation) -> MaskRun:
    """Segment the cases without masks.

    ``existing`` lists (case_id, mask_type) already stored. Outcomes hold ``success``,
    ``skipped``, ``error`` and ``total_volume_mm3`` for every case.
    """
    # A row per case that every step looks up.
    todo = written(unfinished_cases(cases, existing), "todo")
    wanted = voxels.join(todo.select("case_id"), "case_id", "left_semi")
    lung = written(segment_lungs(wanted, todo, **segmentation), "lung")
    masks = region_masks(lung)
    profile = lung.groupBy("case_id", "z").agg(F.count("*").alias("lung_voxels"), F.lit(0).alias("lesion_voxels"))
    statistics = lung_statistics(profile, todo)
    # Fixed value: error text.
    error = F.when(F.col("total_voxels") == 0, "Failed to segment lungs")
    processed = statistics.select(
        "case_id", error.isNull().alias("success"), F.lit(False).alias("skipped"), error.alias("error"), "total_volume_mm3"
    )
    skipped = cases.join(todo.select("case_id"), "case_id", "left_anti").select(
        "case_id", F.lit(True).alias("success"), F.lit(True).alias("skipped"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("total_volume_mm3"),
    )
    return MaskRun(masks, processed.unionByName(skipped))


TIMES = "batch string, started timestamp, ended timestamp, cases long, voxels long, seconds double"


class StoredRun(NamedTuple):
    """Folders of a stored run: masks, one row per case, and one row per batch with its time."""

    masks: str
    outcomes: str
    times: str


def store_masks(voxels: DataFrame, cases: DataFrame, existing: DataFrame, tables: StoredRun, batch: str, **segmentation) -> DataFrame:
    """Segment a batch of cases, store masks and outcomes, and record how long that took; returns the outcomes with ``seconds``.

    All cases of a batch run in one plan, so a processed case has an equal share of the batch's time. Cases and voxels are counted by the
    writes themselves. A batch that is repeated replaces its own rows.
    """
    spark = voxels.sparkSession
    started, clock = datetime.now(timezone.utc), time.perf_counter()
    run = generate_masks(voxels, cases, existing, **segmentation)
    seen, wrote = Observation(), Observation()
    write_masks(run.masks.observe(wrote, F.count_if(F.col("mask_type") == "lung_mask").alias("voxels")), tables.masks)
    staged = written(run.outcomes.observe(seen, F.count_if(~F.col("skipped")).alias("cases")), "outcomes")
    seconds = time.perf_counter() - clock
    count = seen.get["cases"]
    share = F.when(~F.col("skipped"), F.lit(seconds / count if count else None).cast("double"))
    staged.withColumn("seconds", share).write.mode("overwrite").parquet(f"{tables.outcomes.rstrip('/')}/batch={batch}")
    row = (batch, started, datetime.now(timezone.utc), count, wrote.get["voxels"], seconds)
    spark.createDataFrame([row], TIMES).drop("batch").write.mode("overwrite").parquet(f"{tables.times.rstrip('/')}/batch={batch}")
    return spark.read.parquet(tables.outcomes)


def mask_summary(outcomes: DataFrame) -> DataFrame:
    """Processed cases, their times and lung volumes; skipped and failed cases stay out.

    ``seconds`` per case is recorded by ``store_masks``; without it the times are null. The spread is that of the whole population.
    """
    rows = outcomes if "seconds" in outcomes.columns else outcomes.withColumn("seconds", F.lit(None).cast("double"))
    volume = F.when(F.col("total_volume_mm3") > 0, F.col("total_volume_mm3"))
    return rows.where(F.col("success") & ~F.col("skipped")).agg(
        F.count("*").alias("processed_cases"),
        F.avg("seconds").alias("avg_seconds"), F.sum("seconds").alias("total_seconds"),
        F.avg(volume).alias("avg_volume_mm3"), F.min(volume).alias("min_volume_mm3"),
        F.max(volume).alias("max_volume_mm3"), F.stddev_pop(volume).alias("std_volume_mm3"),
    )


def mask_outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("total_cases"), F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"), F.count_if("skipped").alias("skipped"),
    )


def failed_cases(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(~F.col("success")).select("case_id", F.coalesce("error", F.lit("Unknown error")).alias("error"))
