"""Agreement of predicted and true label volumes, from sparse label tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.geometry import ratio
from voxtable.schema import TRAINING_LABELS, VOXEL_KEY


def compare(prediction: DataFrame, truth: DataFrame) -> DataFrame:
    """Voxels labelled on either side, 0 where the other side is empty."""
    left = prediction.where(F.col("label") > 0).select(*VOXEL_KEY, F.col("label").alias("predicted"))
    right = truth.where(F.col("label") > 0).select(*VOXEL_KEY, F.col("label").alias("true"))
    return left.join(right, VOXEL_KEY, "full_outer").fillna(0, ["predicted", "true"])


def class_overlap(compared: DataFrame, slices: DataFrame, classes: Sequence[int] = tuple(TRAINING_LABELS)) -> DataFrame:
    """Shared, predicted and true voxels per slice and class, zero rows included."""
    hits = F.array(
        F.struct(F.col("predicted").alias("label"), F.lit(1).alias("p"), F.lit(0).alias("t")),
        F.struct(F.col("true").alias("label"), F.lit(0).alias("p"), F.lit(1).alias("t")),
    )
    shared = F.when(F.col("predicted") == F.col("true"), 1).otherwise(0)
    counted = (
        compared.select("case_id", "z", shared.alias("both"), F.inline(hits))
        .where(F.col("label") > 0)
        .groupBy("case_id", "z", "label")
        # A match reports twice, once per side.
        .agg((F.sum("both") / 2).cast("bigint").alias("shared"), F.sum("p").alias("predicted"), F.sum("t").alias("true"))
    )
    spine = slices.select("case_id", "z", F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    return spine.join(counted, ["case_id", "z", "label"], "left").fillna(0)


def dice(shared: Column, predicted: Column, true: Column) -> Column:
    """2·shared/(predicted+true): null when both are empty, 0 when only the truth is."""
    return F.when(predicted + true > 0, 2 * shared / (predicted + true))


def smoothed_dice(shared: Column, predicted: Column, true: Column, epsilon: float = 1e-8) -> Column:
    return 2 * shared / (predicted + true + epsilon)


def class_dice(overlap: DataFrame) -> DataFrame:
    return overlap.select("case_id", "z", "label", dice(F.col("shared"), F.col("predicted"), F.col("true")).alias("dice"))


def mean_class_dice(scores: DataFrame) -> DataFrame:
    """Mean of the defined scores per class, 0 for a class without any."""
    return scores.groupBy("label").agg(
        F.coalesce(F.avg("dice"), F.lit(0.0)).alias("mean_dice"), F.count("dice").alias("samples")
    )


def macro_dice(means: DataFrame) -> DataFrame:
    return means.agg(F.avg("mean_dice").alias("macro_dice"))


def slice_overlap(compared: DataFrame, slices: DataFrame) -> DataFrame:
    """Binary (any label) confusion counts per slice; the grid size gives the true negatives.

    ``slices`` holds ``ny`` and ``nx``.
    """
    p, t = F.col("predicted") > 0, F.col("true") > 0
    counted = compared.groupBy("case_id", "z").agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn")
    )
    rows = slices.select("case_id", "z", "ny", "nx").join(counted, ["case_id", "z"], "left").fillna(0)
    negatives = F.col("ny").cast("bigint") * F.col("nx") - F.col("tp") - F.col("fp") - F.col("fn")
    return rows.withColumn("tn", negatives).drop("ny", "nx")


def mean_smoothed_dice(confusion: DataFrame) -> DataFrame:
    """Mean over slices of the smoothed binary Dice."""
    score = smoothed_dice(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return confusion.agg(F.avg(score).alias("mean_dice"), F.count("*").alias("samples"))


def detection_metrics(confusion: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """Precision, recall, specificity, F1 and Dice over all, background and lesion slices."""
    kind = F.when(F.col("tp") + F.col("fn") > 0, "lesion").otherwise("background")
    groups = confusion.withColumn("slices", F.explode(F.array(F.lit("all"), kind)))
    sums = groups.groupBy("slices").agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "tn", "fn")])
    tp, fp, tn, fn = (F.col(n) for n in ("tp", "fp", "tn", "fn"))
    precision, recall = tp / (tp + fp + epsilon), tp / (tp + fn + epsilon)
    return sums.withColumns({
        "precision": precision,
        "recall": recall,
        "specificity": tn / (tn + fp + epsilon),
        "f1": 2 * precision * recall / (precision + recall + epsilon),
        "dice": 2 * tp / (2 * tp + fp + fn + epsilon),
    })


def case_detections(cases: DataFrame, prediction: DataFrame) -> DataFrame:
    """Predicted voxels of every case and whether any lesion was found."""
    found = prediction.where(F.col("label") > 0).groupBy("case_id").agg(F.count("*").alias("lesion_voxels"))
    rows = cases.select("case_id").join(found, "case_id", "left").fillna(0)
    return rows.withColumn("detected", F.col("lesion_voxels") > 0)


def detection_summary(detections: DataFrame) -> DataFrame:
    return detections.agg(
        F.count("*").alias("total_cases"),
        F.count_if("detected").alias("lesion_detected"),
        F.count_if(~F.col("detected")).alias("no_lesion"),
    )


def background_check(confusion: DataFrame) -> DataFrame:
    """On slices without true lesions: how often something or nothing is predicted."""
    clean = confusion.where(F.col("tp") + F.col("fn") == 0)
    counted = clean.agg(F.count("*").alias("background_slices"), F.count_if(F.col("fp") > 0).alias("false_positive_slices"))
    wrong, whole = F.col("false_positive_slices"), F.col("background_slices")
    return counted.select("*", ratio(wrong, whole).alias("false_positive_rate"), ratio(whole - wrong, whole).alias("background_accuracy"))
