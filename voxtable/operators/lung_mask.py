"""Threshold lung masks for all slices at once, and their upper and lower parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.functions.intensity import LUNG_THRESHOLD_HU, below_threshold
from voxtable.operators.components import connect, keep_components
from voxtable.operators.planar import SLICE, fill_holes, inner_components, reshaped, second_largest_up
from voxtable.operators.regions import UPPER_LOWER_PERCENTILE, region_cut
from voxtable.session import written


def segment_lungs(
    voxels: DataFrame, cases: DataFrame, threshold: float = LUNG_THRESHOLD_HU, erosion: int = 2, closing: int = 10
) -> DataFrame:
    """Pixels of the lung mask: threshold, inner parts, the two largest, smoothing, outline, filling."""
    dark = voxels.where(below_threshold(F.col("hu"), threshold)).select("case_id", "z", "y", "x")
    labelled, roots = connect(dark, SLICE, ["y", "x"], stacked="z")
    lungs = second_largest_up(inner_components(labelled, roots, cases))
    parts = written(keep_components(labelled, roots, lungs, SLICE), "parts")
    steps = [("erode", erosion), ("dilate", closing), ("erode", closing), ("edges", 0)]
    return fill_holes(written(reshaped(parts, cases, steps), "outline"))


def region_masks(lung: DataFrame, percentile: float = UPPER_LOWER_PERCENTILE) -> DataFrame:
    """Rows (case, mask_type, z, y, x) for the whole, upper and lower lung."""
    cut = region_cut(lung.groupBy("case_id", "z").agg(F.count("*").alias("lung_voxels")), percentile)
    side = F.when(F.col("z") >= F.col("z_cut"), "upper_lung").otherwise("lower_lung")
    placed = lung.select("case_id", "z", "y", "x").where(F.col("case_id").isNotNull()).join(cut, "case_id", "left")  # every case of the lung has a cut
    return placed.select("case_id", F.explode(F.array(F.lit("lung_mask"), side)).alias("mask_type"), "z", "y", "x")
