"""Depth measures: axial distribution, zones, gradient, subpleural bands and contact.

All case-level measures read a depth histogram (voxels per case and distinct
distance). Distances repeat heavily inside a volume, so the histogram is far
smaller than the voxels and map-side counting does most of the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.geometry import (
    BANDS, CONTACT_MM, GRADIENT_BINS, PERIPHERAL_MM, PERIPHERAL_RATIO, SUBPLEURAL_MM, ZONES,
    concentric_zone, distance_band, gradient_bin, is_peripheral, ratio,
)
from voxtable.operators import rules
from voxtable.operators.components import connect


def depth_histogram(features: DataFrame, *extra_keys: str) -> DataFrame:
    """Lung and lesion voxels per case and distance; voxels without a distance drop out."""
    return (
        features.where(F.col("dist_mm").isNotNull())
        .groupBy("case_id", *extra_keys, "dist_mm")
        .agg(F.count("*").alias("lung_voxels"), F.count_if(F.col("lesion") > 0).alias("lesion_voxels"))
    )


def _lesion_sum(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("lesion_voxels")).otherwise(0))


def axial_distribution(
    histogram: DataFrame, cases: DataFrame,
    peripheral_mm: float = PERIPHERAL_MM, peripheral_ratio: float = PERIPHERAL_RATIO, share: float = 0.70,
) -> DataFrame:
    """Distance statistics of lesion voxels and the peripheral / central split, for every case."""
    deepest = histogram.groupBy("case_id").agg(F.max("dist_mm").alias("max_radius_mm"))
    near = is_peripheral(F.col("dist_mm"), F.col("max_radius_mm"), peripheral_mm, peripheral_ratio)
    lesion = F.when(F.col("lesion_voxels") > 0, F.col("dist_mm"))
    measured = (
        histogram.join(deepest, "case_id")
        .groupBy("case_id", "max_radius_mm")
        .agg(
            (F.sum(F.col("dist_mm") * F.col("lesion_voxels")) / F.nullif(F.sum("lesion_voxels"), F.lit(0))).alias("mean_distance_mm"),
            F.min(lesion).alias("min_distance_mm"),
            F.max(lesion).alias("max_distance_mm"),
            F.sum("lesion_voxels").alias("total_lesion_voxels"),
            _lesion_sum(near).alias("peripheral_voxels"),
            _lesion_sum(~near).alias("central_voxels"),
        )
        .where(F.col("total_lesion_voxels") > 0)
    )
    rows = cases.select("case_id").join(measured, "case_id", "left")
    known = F.col("total_lesion_voxels").isNotNull()
    rows = rows.withColumn("known", known).fillna(0)
    peripheral = ratio(F.col("peripheral_voxels"), F.col("total_lesion_voxels"))
    central = ratio(F.col("central_voxels"), F.col("total_lesion_voxels"))
    pattern = rules.axial_pattern(peripheral, central, share)
    return rows.select(
        "case_id", "max_radius_mm", "mean_distance_mm", "min_distance_mm", "max_distance_mm", "total_lesion_voxels",
        "peripheral_voxels", "central_voxels",
        peripheral.alias("peripheral_ratio"), central.alias("central_ratio"),
        F.when(F.col("known"), pattern).otherwise(F.lit("unknown")).alias("axial_distribution"),
    )


def slice_distribution(
    features: DataFrame, peripheral_mm: float = PERIPHERAL_MM, peripheral_ratio: float = PERIPHERAL_RATIO
) -> DataFrame:
    """Per slice with lesions: voxels, peripheral share against the slice's deepest point, mean distance."""
    histogram = depth_histogram(features, "z")
    deepest = histogram.groupBy("case_id", "z").agg(F.max("dist_mm").alias("max_radius_mm"))
    near = is_peripheral(F.col("dist_mm"), F.col("max_radius_mm"), peripheral_mm, peripheral_ratio)
    return (
        histogram.join(deepest, ["case_id", "z"])
        .groupBy("case_id", "z")
        .agg(
            F.sum("lesion_voxels").alias("total_lesion_voxels"),
            _lesion_sum(near).alias("near"),
            F.sum(F.col("dist_mm") * F.col("lesion_voxels")).alias("weighted"),
        )
        .where(F.col("total_lesion_voxels") > 0)
        .select(
            "case_id", "z", "total_lesion_voxels",
            (F.col("near") / F.col("total_lesion_voxels")).alias("peripheral_ratio"),
            (F.col("weighted") / F.col("total_lesion_voxels")).alias("mean_distance_mm"),
        )
    )


def _spine(cases: DataFrame, size: int, name: str) -> DataFrame:
    return cases.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name))


def concentric_zones(histogram: DataFrame, cases: DataFrame) -> DataFrame:
    """Lesion voxels, lung voxels and density in the three zones of every case."""
    counted = (
        histogram.withColumn("zone", concentric_zone(F.col("dist_mm")))
        .groupBy("case_id", "zone")
        .agg(F.sum("lesion_voxels").alias("lesion_count"), F.sum("lung_voxels").alias("lung_voxels"))
    )
    rows = _spine(cases, len(ZONES), "zone").join(counted, ["case_id", "zone"], "left").fillna(0)
    names = F.array(*[F.lit(name) for name, _, _ in ZONES])
    return rows.select(
        "case_id", "zone", F.get(names, F.col("zone")).alias("zone_name"), "lesion_count", "lung_voxels",
        ratio(F.col("lesion_count"), F.col("lung_voxels")).alias("lesion_density"),
    )


def distance_gradient(histogram: DataFrame, cases: DataFrame, bins: int = GRADIENT_BINS) -> DataFrame:
    """Lesion density in equal distance bins; the first bin counts everything outside the lung too."""
    deepest = histogram.groupBy("case_id").agg(
        F.max("dist_mm").alias("max_dist"), F.sum("lung_voxels").alias("all_lung")
    )
    counted = (
        histogram.join(deepest.select("case_id", "max_dist"), "case_id")
        .withColumn("bin", gradient_bin(F.col("dist_mm"), F.col("max_dist"), bins))
        .groupBy("case_id", "bin")
        .agg(F.sum("lesion_voxels").alias("lesion_voxels"), F.sum("lung_voxels").alias("lung_voxels"))
    )
    sized = cases.join(deepest, "case_id").select(
        "case_id", "max_dist", (F.col("nz").cast("bigint") * F.col("ny") * F.col("nx") - F.col("all_lung")).alias("outside")
    )
    rows = _spine(sized, bins, "bin").join(sized, "case_id").join(counted, ["case_id", "bin"], "left").fillna(0)
    voxels = F.col("lung_voxels") + F.when(F.col("bin") == 0, F.col("outside")).otherwise(0)
    low, high = F.col("bin") * F.col("max_dist") / bins, (F.col("bin") + 1) * F.col("max_dist") / bins
    return rows.select(
        "case_id", "bin", ((low + high) / 2).alias("bin_center"), voxels.alias("voxels"), "lesion_voxels",
        ratio(F.col("lesion_voxels"), voxels).alias("lesion_density"),
    )


def gradient_trend(gradient: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Correlation of bin centre and density with a word for it; constant densities are uniform.

    The coefficient of a constant series is undefined and raises in ANSI mode, so it is
    only formed where the densities differ.
    """
    n, x, y = F.count("*"), F.col("bin_center"), F.col("lesion_density")
    moments = gradient.groupBy("case_id").agg(
        n.alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"),
        F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.min(y).alias("low"), F.max(y).alias("high"),
    )
    spread = F.sqrt((F.col("n") * F.col("xx") - F.col("x") ** 2) * (F.col("n") * F.col("yy") - F.col("y") ** 2))
    value = F.when(F.col("low") < F.col("high"), F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), spread))
    trend = (
        F.when(value > threshold, "increasing_centrally")
        .when(value < -threshold, "decreasing_centrally")
        .otherwise("uniform")
    )
    return moments.select("case_id", value.alias("correlation"), trend.alias("trend"))


def subpleural_features(histogram: DataFrame, cases: DataFrame, limit_mm: float = SUBPLEURAL_MM) -> DataFrame:
    """Involvement within ``limit_mm`` of the surface and contact with it, for every case."""
    lesions = histogram.where(F.col("lesion_voxels") > 0)
    near = F.col("dist_mm") <= limit_mm
    counted = lesions.groupBy("case_id").agg(
        F.sum("lesion_voxels").alias("total_lesion_voxels"),
        F.min("dist_mm").alias("min_distance_mm"),
        _lesion_sum(near).alias("subpleural_voxels"),
        F.sum(F.when(near, F.col("dist_mm") * F.col("lesion_voxels"))).alias("near_sum"),
        _lesion_sum(F.col("dist_mm") < 2).alias("within_2mm"),
        _lesion_sum(F.col("dist_mm") <= CONTACT_MM).alias("contact_voxels"),
    )
    rows = cases.select("case_id").join(counted, "case_id", "left").fillna(0)
    total = F.col("total_lesion_voxels")
    involved = (total > 0) & (F.col("min_distance_mm") <= limit_mm)
    return rows.select(
        "case_id", "total_lesion_voxels", "min_distance_mm", "subpleural_voxels",
        ratio(F.col("subpleural_voxels"), total).alias("subpleural_ratio"),
        ratio(F.col("near_sum"), F.col("subpleural_voxels")).alias("mean_subpleural_distance_mm"),
        involved.alias("subpleural_involvement"),
        F.when(involved, "subpleural").otherwise("subpleural_omitted").alias("subpleural_features"),
        (ratio(F.col("within_2mm"), total) * 100).alias("within_2mm_percent"),
        "contact_voxels",
        (ratio(F.col("contact_voxels"), total) * 100).alias("contact_percent"),
        (F.col("contact_voxels") > 0).alias("direct_contact"),
    )


def subpleural_bands(histogram: DataFrame, cases: DataFrame) -> DataFrame:
    """Lesion voxels and percent in the five distance bands of every case."""
    lesions = histogram.where(F.col("lesion_voxels") > 0)
    counted = (
        lesions.withColumn("band", distance_band(F.col("dist_mm")))
        .groupBy("case_id", "band")
        .agg(F.sum("lesion_voxels").alias("voxels"))
    )
    whole = counted.groupBy("case_id").agg(F.sum("voxels").alias("whole"))
    rows = (
        _spine(cases, len(BANDS), "band")
        .join(counted, ["case_id", "band"], "left")
        .join(whole, "case_id", "left")
        .fillna(0)
    )
    names = F.array(*[F.lit(name) for name, _, _ in BANDS])
    return rows.select(
        "case_id", "band", F.get(names, F.col("band")).alias("band_name"), "voxels",
        (ratio(F.col("voxels"), F.col("whole")) * 100).alias("percent"),
    )


def contact_regions(features: DataFrame, tolerance_mm: float = CONTACT_MM, tile: int | None = None) -> DataFrame:
    """Number of separate (26-connected) lesion regions on the surface; only cases with contact."""
    contact = features.where((F.col("lesion") > 0) & (F.col("dist_mm") <= tolerance_mm))
    _, roots = connect(contact, ["case_id"], ["z", "y", "x"], tile=tile)
    # A component is its own smallest root, so counting those needs no distinct.
    return (
        roots.where(F.col("root") == F.col("component"))
        .groupBy("case_id")
        .agg(F.count("*").alias("contact_regions"))
    )
