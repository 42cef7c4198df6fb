"""Lesion types per case: counts, volumes, shares, dominant lesion, lung coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.functions.geometry import ratio, voxel_volume
from voxtable.functions.joins import shuffled
from voxtable.schema import ANALYSIS_LABELS


def lesion_counts(voxels: DataFrame) -> DataFrame:
    """Voxels per case and label, the background left out."""
    return voxels.where(F.col("lesion") > 0).groupBy("case_id", "lesion").agg(F.count("*").alias("voxels"))


def named(rows: DataFrame, labels: DataFrame, scheme: str = "analysis", label: str = "lesion") -> DataFrame:
    """Attach label names; unknown labels drop out. The dimension has a fixed handful of rows."""
    names = labels.where(F.col("scheme") == scheme).select(F.col("label_id").alias(label), "name")
    return rows.join(F.broadcast(names), label)


def unknown_labels(rows: DataFrame, labels: DataFrame, scheme: str = "analysis", label: str = "lesion") -> DataFrame:
    names = labels.where(F.col("scheme") == scheme).select(F.col("label_id").alias(label))
    return rows.join(F.broadcast(names), label, "left_anti")


def lesion_types(voxels: DataFrame, cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Per case and known label: voxels, volume and percent of all lesion voxels of the case."""
    whole = F.sum("voxels").over(Window.partitionBy("case_id"))
    volume = voxel_volume(F.col("sz"), F.col("sy"), F.col("sx"))
    return (
        named(lesion_counts(voxels), labels)
        .join(cases, "case_id")
        .select(
            "case_id", "lesion", "name", "voxels",
            (F.col("voxels") * volume).alias("volume_mm3"),
            (F.col("voxels") / whole * 100).alias("percent"),
        )
    )


def lesion_summary(profile: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per case, also without lesions: counts per type, totals, dominant lesion.

    Reads the slice profile (``regions.slice_profile``), not the voxels. The lowest label id
    wins a tie for the dominant lesion.
    """
    names = list(ANALYSIS_LABELS.values())
    counted = profile.groupBy("case_id").agg(*[F.sum(f"n_{name}").alias(f"n_{name}") for name in names])
    rows = cases.join(counted, "case_id", "left").fillna(0, [f"n_{name}" for name in names])
    total = sum((F.col(f"n_{name}") for name in names), F.lit(0))
    largest = F.greatest(*[F.col(f"n_{name}") for name in names])
    # The first match in label order is the lowest label id.
    dominant = F.coalesce(*[F.when((largest > 0) & (F.col(f"n_{name}") == largest), F.lit(name)) for name in names])
    present = F.array_compact(F.array(*[F.when(F.col(f"n_{name}") > 0, F.lit(name)) for name in names]))
    volume = voxel_volume(F.col("sz"), F.col("sy"), F.col("sx"))
    return rows.select(
        "case_id", *[f"n_{name}" for name in names], present.alias("lesion_types"),
        total.alias("total_lesion_voxels"), (total * volume).alias("total_lesion_volume"), dominant.alias("dominant_lesion"),
    )


def lung_coverage(profile: DataFrame) -> DataFrame:
    """Lung voxels, lesion voxels inside the lung, and their ratio, per case."""
    totals = profile.groupBy("case_id").agg(
        F.sum("lung_voxels").alias("lung_voxels"), F.sum("lesion_voxels").alias("lesion_voxels")
    )
    share = ratio(F.col("lesion_voxels"), F.col("lung_voxels"))
    return totals.select("*", share.alias("lesion_lung_ratio"), (share * 100).alias("coverage_percent"))


def lesions_in_lung(voxels: DataFrame) -> DataFrame:
    return voxels.where((F.col("lesion") > 0) & (F.col("lung") > 0))


def lesions_in_mask(lesions: DataFrame, mask: DataFrame) -> DataFrame:
    """Lesion voxels of a sparse table that lie in a separately stored mask."""
    return lesions.join(shuffled(mask.select("case_id", "z", "y", "x")), ["case_id", "z", "y", "x"], "left_semi")
