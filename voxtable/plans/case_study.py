"""Case analysis: four variables, classification and batch summary over all cases in one plan."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.functions.grading import percent_text
from voxtable.operators import depth, regions, rules
from voxtable.operators.annotations import value_counts
from voxtable.operators.distance import voxel_features
from voxtable.operators.lesions import lesion_summary, lung_coverage
from voxtable.session import written


#: Labels from 0 up to here travel with the distance map.
LABELS = 256


class Study(NamedTuple):
    """Result tables of a case analysis."""

    features: DataFrame
    classified: DataFrame
    results: DataFrame
    failures: DataFrame


def case_features(
    voxels: DataFrame, cases: DataFrame, rule: str = "density", profile: DataFrame | None = None
) -> DataFrame:
    """One row per case with the variables the rules read.

    The voxels are read twice: for the slice profile, and for the distance map, of which
    only the depth histogram is kept. ``rule="gap"`` reads given ``upper`` and ``lower``
    mask columns as well.
    """
    profile = written(regions.slice_profile(voxels), "profile") if profile is None else profile
    histogram = written(depth.depth_histogram(voxel_features(voxels, cases)), "depth")
    counts = regions.mask_region_counts(voxels) if rule == "gap" else regions.region_counts(profile)
    lesions = rules.lesion_pattern(lesion_summary(profile, cases))
    distribution = regions.lung_distribution(counts, cases, rule).withColumnsRenamed({
        "total_lesion_voxels": "lung_lesion_voxels", "total_lesion_volume": "lung_lesion_volume",
    })
    axial = depth.axial_distribution(histogram, cases).select(
        "case_id", "max_radius_mm", "mean_distance_mm", "peripheral_voxels", "central_voxels",
        "peripheral_ratio", "central_ratio", "axial_distribution",
    )
    subpleural = depth.subpleural_features(histogram, cases).drop("total_lesion_voxels")
    return (
        lesions.join(distribution, "case_id").join(axial, "case_id").join(subpleural, "case_id")
    )


def _checked(profile: DataFrame, cases: DataFrame) -> DataFrame:
    """``error`` per case, decided before the heavy part: no voxels, no lung, or a case row or label that cannot be right."""
    limits = profile.groupBy("case_id").agg(
        F.min("z").alias("z_low"), F.max("z").alias("z_high"),
        *[f(f"{c}_{name}").alias(f"{c}_{name}") for c in ("y", "x", "lesion") for name, f in (("low", F.min), ("high", F.max))],
    )
    coverage = lung_coverage(profile).select("case_id", "lung_voxels").join(limits, "case_id")
    rows = cases.join(coverage, "case_id", "left")
    spacing = [(F.col(f"s{a}") > 0) & (F.col(f"s{a}") < float("inf")) for a in "zyx"]
    inside = [(F.col(f"{a}_low") >= 0) & (F.col(f"{a}_high") < F.col(f"n{a}")) for a in "zyx"]
    labels = (F.col("lesion_low") >= 0) & (F.col("lesion_high") < LABELS)
    every = lambda parts: F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))
    # Error texts.
    error = F.when(F.col("lung_voxels").isNull(), "Failed to load case data").when(
        ~every(spacing), "Invalid voxel spacing"
    ).when(~every(inside), "Voxels outside the volume").when(~every([labels]), "Lesion label out of range").when(
        F.col("lung_voxels") == 0, "Failed to segment lungs"
    )
    return rows.withColumn("error", error)


def case_results(features: DataFrame, classified: DataFrame) -> DataFrame:
    """One nested result per case, ready for a JSON sink."""
    summary = rules.classification_summary(classified)
    variables = rules.four_variables(features)
    rows = features.join(classified, "case_id")
    nested = rows.select(
        "case_id",
        F.struct(
            F.struct("lesion_types", "total_lesion_voxels", "total_lesion_volume", "dominant_lesion",
                     "lesion_pattern", "lesion_pattern_confidence", "lesion_pattern_reasons").alias("lesion_type"),
            F.struct("z_cut", "upper_lesion_ratio", "lower_lesion_ratio", "upper_lesion_proportion",
                     "lower_lesion_proportion", "distribution_pattern").alias("lung_distribution"),
            F.struct("max_radius_mm", "mean_distance_mm", "peripheral_ratio", "central_ratio",
                     "axial_distribution").alias("axial_distribution"),
            F.struct("min_distance_mm", "subpleural_ratio", "subpleural_involvement", "subpleural_features",
                     "direct_contact", "contact_percent").alias("subpleural_features"),
        ).alias("features"),
        F.struct("predicted_pattern", "confidence", "certainty_level", "reasoning", "differential").alias("classification"),
    )
    return (
        nested.join(summary.select("case_id", F.struct(*[c for c in summary.columns if c != "case_id"]).alias("summary")), "case_id")
        .join(variables.select("case_id", F.struct(*[c for c in variables.columns if c != "case_id"]).alias("four_variables")), "case_id")
    )


def analyse(voxels: DataFrame, cases: DataFrame, rule: str = "density") -> Study:
    """Analyse every case; cases that cannot be analysed become failures and do not stop the rest."""
    profile = written(regions.slice_profile(voxels, limits=True), "profile")
    checked = written(_checked(profile, cases), "checked")
    failures = checked.where("error is not null").select("case_id", "error")
    sound = checked.where("error is null").select(*cases.columns)
    # The join to the case table keeps failed cases out of the heavy side.
    features = written(case_features(voxels, sound, rule, profile), "features")
    classified = rules.classify(features)
    return Study(features, classified, case_results(features, classified), failures)


def result_envelopes(study: Study) -> DataFrame:
    """One nested row per case, failed ones included: case_id, success, error, features, classification, summary, four_variables, lung_statistics."""
    parts = [F.col(f"{side}_lung_{kind}") for kind in ("voxels", "volume") for side in ("total", "upper", "lower")]
    lung = study.features.select("case_id", F.struct(*parts, "z_cut").alias("lung_statistics"))
    good = study.results.join(lung, "case_id").withColumns({"success": F.lit(True), "error": F.lit(None).cast("string")})
    columns = ["case_id", "success", "error", "features", "classification", "summary", "four_variables", "lung_statistics"]
    failed = study.failures.withColumn("success", F.lit(False))
    return good.select(*columns).unionByName(failed, allowMissingColumns=True)


def case_statuses(study: Study) -> DataFrame:
    """(case_id, success, error) of all cases."""
    good = study.features.select("case_id", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(study.failures.select("case_id", F.lit(False).alias("success"), "error"))


def outcome_counts(statuses: DataFrame) -> DataFrame:
    return statuses.agg(
        F.count("*").alias("total_cases"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed")
    )


def pattern_distribution(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.col("predicted_pattern").alias("pattern")).agg(F.count("*").alias("cases"))


def feature_statistics(features: DataFrame) -> DataFrame:
    """Counts of dominant lesion, distribution and axial pattern over the cases."""
    return value_counts(features, ["dominant_lesion", "distribution_pattern", "axial_distribution"])


def involvement_rate(features: DataFrame) -> DataFrame:
    rate = F.avg(F.when(F.col("subpleural_involvement"), 1.0).otherwise(0.0))
    return features.agg(rate.alias("rate")).withColumn("rate_text", percent_text(F.col("rate")))
