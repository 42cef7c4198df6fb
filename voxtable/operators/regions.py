"""Upper and lower lung: the cut, volumes and lesion shares.

Everything follows from one slice profile (counts per case and z), so the voxels
are shuffled only as partial counts and never joined to the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.functions.geometry import ratio, voxel_volume
from voxtable.operators import rules
from voxtable.schema import ANALYSIS_LABELS

UPPER_LOWER_PERCENTILE = 60.0


def slice_profile(voxels: DataFrame, limits: bool = False) -> DataFrame:
    """Lung voxels, lesion-in-lung voxels and voxels per lesion label, by case and slice.

    ``limits`` adds the smallest and largest y, x and lesion label.
    """
    in_lung = F.col("lung") > 0
    return voxels.groupBy("case_id", "z").agg(
        F.count_if(in_lung).alias("lung_voxels"),
        F.count_if(in_lung & (F.col("lesion") > 0)).alias("lesion_voxels"),
        *[F.count_if(F.col("lesion") == label).alias(f"n_{name}") for label, name in ANALYSIS_LABELS.items()],
        *[f(c).alias(f"{c}_{name}") for c in ("y", "x", "lesion") * limits for name, f in (("low", F.min), ("high", F.max))],
    )


def _cut(percentile: float) -> Column:
    weight = F.nullif(F.col("lung_voxels"), F.lit(0))
    z = F.when(weight.isNotNull(), F.col("z"))
    return F.percentile(z, F.lit(percentile / 100), F.coalesce(weight, F.lit(1)))


def region_cut(profile: DataFrame, percentile: float = UPPER_LOWER_PERCENTILE) -> DataFrame:
    """Slice that divides the lung: the percentile of z over lung voxels, cut to a whole number."""
    weighted = profile.where(F.col("lung_voxels") > 0)
    return weighted.groupBy("case_id").agg(_cut(percentile).cast("int").alias("z_cut"))


def region_counts(profile: DataFrame, percentile: float = UPPER_LOWER_PERCENTILE) -> DataFrame:
    """Lung and lesion voxels above and below the cut; cases without lung voxels have no row.

    The cut is a window over the slices of a case, so the profile is computed once.
    """
    cut = _cut(percentile).over(Window.partitionBy("case_id")).cast("int")
    upper = F.col("z") >= F.col("z_cut")
    return (
        profile.select("case_id", "z", "lung_voxels", "lesion_voxels")
        .withColumn("z_cut", cut)
        .where(F.col("z_cut").isNotNull())
        .groupBy("case_id", "z_cut")
        .agg(
            F.sum(F.when(upper, F.col("lung_voxels")).otherwise(0)).alias("upper_lung_voxels"),
            F.sum(F.when(~upper, F.col("lung_voxels")).otherwise(0)).alias("lower_lung_voxels"),
            F.sum(F.when(upper, F.col("lesion_voxels")).otherwise(0)).alias("upper_lesion_voxels"),
            F.sum(F.when(~upper, F.col("lesion_voxels")).otherwise(0)).alias("lower_lesion_voxels"),
            F.sum("lung_voxels").alias("total_lung_voxels"),
            F.sum("lesion_voxels").alias("total_lesion_voxels"),
        )
    )


def mask_region_counts(voxels: DataFrame) -> DataFrame:
    """The same counts from given ``upper`` and ``lower`` mask columns.

    The cut is the middle between the lowest upper and the highest lower slice.
    """
    lesion = F.col("lesion") > 0
    upper, lower, lung = F.col("upper") > 0, F.col("lower") > 0, F.col("lung") > 0
    counts = voxels.groupBy("case_id").agg(
        F.min(F.when(upper, F.col("z"))).alias("upper_z"),
        F.max(F.when(lower, F.col("z"))).alias("lower_z"),
        F.count_if(upper).alias("upper_lung_voxels"),
        F.count_if(lower).alias("lower_lung_voxels"),
        F.count_if(upper & lesion).alias("upper_lesion_voxels"),
        F.count_if(lower & lesion).alias("lower_lesion_voxels"),
        F.count_if(lung).alias("total_lung_voxels"),
        F.count_if(lung & lesion).alias("total_lesion_voxels"),
    )
    middle = ((F.col("upper_z") + F.col("lower_z")) / 2).cast("int")
    return counts.withColumn("z_cut", middle).drop("upper_z", "lower_z")


def lung_distribution(counts: DataFrame, cases: DataFrame, rule: str = "density") -> DataFrame:
    """Volumes, densities, proportions and pattern for every case.

    ``rule`` is ``density`` (predominance at 65 % with a density tie-break) or ``gap``
    (predominance above 70 %, else the gap between the sides).
    """
    numbers = [
        "upper_lung_voxels", "lower_lung_voxels", "upper_lesion_voxels", "lower_lesion_voxels",
        "total_lung_voxels", "total_lesion_voxels",
    ]
    volume = voxel_volume(F.col("sz"), F.col("sy"), F.col("sx"))
    known = F.col("total_lung_voxels").isNotNull()
    rows = cases.join(counts, "case_id", "left").withColumn("known", known).fillna(0, numbers)
    rows = rows.select(
        "case_id", "known", "z_cut", *numbers,
        *[(F.col(n) * volume).alias(n.replace("voxels", "volume")) for n in numbers],
        ratio(F.col("upper_lesion_voxels"), F.col("upper_lung_voxels")).alias("upper_lesion_ratio"),
        ratio(F.col("lower_lesion_voxels"), F.col("lower_lung_voxels")).alias("lower_lesion_ratio"),
        ratio(F.col("upper_lesion_voxels"), F.col("total_lesion_voxels")).alias("upper_lesion_proportion"),
        ratio(F.col("lower_lesion_voxels"), F.col("total_lesion_voxels")).alias("lower_lesion_proportion"),
    )
    sides = [F.col("upper_lesion_proportion"), F.col("lower_lesion_proportion")]
    if rule == "gap":
        pattern = rules.gap_distribution(*sides)
    else:
        pattern = rules.density_distribution(*sides, F.col("upper_lesion_ratio"), F.col("lower_lesion_ratio"))
    return rows.withColumn(
        "distribution_pattern", F.when(F.col("known"), pattern).otherwise(F.lit("unknown"))
    ).drop("known")


def lung_statistics(profile: DataFrame, cases: DataFrame, percentile: float = UPPER_LOWER_PERCENTILE) -> DataFrame:
    """Voxels and volume of the lung and its two parts, per case."""
    volume = voxel_volume(F.col("sz"), F.col("sy"), F.col("sx"))
    rows = cases.join(region_counts(profile, percentile), "case_id", "left").fillna(0, ["total_lung_voxels"])
    return rows.select(
        "case_id",
        F.col("total_lung_voxels").alias("total_voxels"),
        (F.col("total_lung_voxels") * volume).alias("total_volume_mm3"),
        "z_cut",
        F.col("upper_lung_voxels").alias("upper_voxels"),
        F.col("lower_lung_voxels").alias("lower_voxels"),
        (F.col("upper_lung_voxels") * volume).alias("upper_volume_mm3"),
        (F.col("lower_lung_voxels") * volume).alias("lower_volume_mm3"),
    )
