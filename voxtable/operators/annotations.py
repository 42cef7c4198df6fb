"""Annotation rows to case records, counts and statistics.

Input columns: ``row_no, file_id, layer, axial, manifestation, lesion``. ``row_no``
is the order of the source file; it settles ties the way a sequential reader would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions import terms
from voxtable.schema import LESION_TERMS


def with_file(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=["file_id"])


def _counted(rows: DataFrame) -> DataFrame:
    """How often each file gives each value of axial, manifestation and lesion, and where first: one pass, combined before the shuffle.

    Every file has a row with attribute ``file``.
    """
    pairs = F.array(
        F.struct(F.lit("file").alias("attribute"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(name).alias("attribute"), F.col(name).alias("value")) for name in ("axial", "manifestation", "lesion")],
    )
    unfolded = with_file(rows).select("file_id", "row_no", F.inline(pairs)).where((F.col("attribute") == "file") | F.col("value").isNotNull())
    return unfolded.groupBy("file_id", "attribute", "value").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"))


def _most_frequent(attribute: str) -> Column:
    """Most frequent value of an attribute, the first seen on a tie; null if there is none."""
    return F.max_by("value", F.when(F.col("attribute") == attribute, F.struct(F.col("n"), -F.col("first_row"))))


def _presence() -> Column:
    given = F.col("attribute") == "lesion"
    return F.array(*[F.max(F.when(given & (F.col("value") == term), 1).otherwise(0)) for term in LESION_TERMS])


def file_terms(rows: DataFrame) -> DataFrame:
    """One row per file: English axial and manifestation term, ``unknown`` where none is given, and 0/1 per lesion term in vocabulary order."""
    return _counted(rows).groupBy("file_id").agg(
        terms.axial_name(terms.or_unknown(_most_frequent("axial"))).alias("overall_axial_distribution"),
        terms.manifestation_name(terms.or_unknown(_most_frequent("manifestation"))).alias("overall_manifestation"),
        _presence().alias("abnormal_manifestation_presence"),
    )


def frequent_terms(rows: DataFrame, term: str) -> DataFrame:
    """Most frequent term per file, the first seen on a tie; files without a term have no row."""
    return _counted(rows).groupBy("file_id").agg(_most_frequent(term).alias(term)).where(F.col(term).isNotNull())


def overall_terms(rows: DataFrame) -> DataFrame:
    return file_terms(rows).drop("abnormal_manifestation_presence")


def lesion_presence(rows: DataFrame) -> DataFrame:
    """0/1 per lesion term and file, in vocabulary order."""
    return file_terms(rows).select("file_id", "abnormal_manifestation_presence")


def roi_arrays(rows: DataFrame) -> DataFrame:
    """Regions of a file by layer (file order within a layer) as three parallel arrays."""
    roi = F.struct(
        terms.zero_based_layer(F.col("layer")).alias("layer"),
        F.col("row_no"),
        terms.axial_name(terms.or_unknown(F.col("axial"))).alias("axial"),
        terms.manifestation_name(terms.or_unknown(F.col("manifestation"))).alias("manifestation"),
    )
    return (
        with_file(rows)
        .groupBy("file_id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("layer").isNotNull(), roi))).alias("rois"))
        .select(
            "file_id",
            F.col("rois.layer").alias("roi_layers"),
            F.col("rois.axial").alias("roi_axial_distributions"),
            F.col("rois.manifestation").alias("roi_manifestations"),
        )
    )


def case_records(rows: DataFrame) -> DataFrame:
    """One record per file, in the layout of the case-record files.

    The layout holds all regions of a file in one row; statistics that need no regions read ``file_terms``.
    """
    return (
        file_terms(rows)
        .join(roi_arrays(rows), "file_id")
        .select(
            F.col("file_id").alias("filename"),
            terms.disease_pattern(F.col("file_id")).alias("disease_pattern"),
            "overall_axial_distribution", "overall_manifestation", "abnormal_manifestation_presence",
            "roi_layers", "roi_axial_distributions", "roi_manifestations",
        )
    )


def lesion_mark_counts(rows: DataFrame) -> DataFrame:
    """Regions per lesion term over all files, whether or not they name a layer."""
    return with_file(rows).agg(
        *[F.count_if(F.col("lesion") == term).alias(name) for term, name in LESION_TERMS.items()]
    )


def roi_statistics(records: DataFrame) -> DataFrame:
    count = F.size("roi_layers")
    return records.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum(count), F.lit(0)).alias("total_rois"),
        F.avg(count).alias("avg_rois_per_file"),
        F.min(count).alias("min_rois_per_file"),
        F.max(count).alias("max_rois_per_file"),
    )


def value_counts(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """(attribute, value, count) of several columns in one pass; nulls are not counted."""
    pairs = F.array(*[F.struct(F.lit(name).alias("attribute"), F.col(name).alias("value")) for name in attributes])
    return (
        rows.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("attribute", "value")
        .agg(F.count("*").alias("count"))
    )


def category_counts(records: DataFrame) -> DataFrame:
    return value_counts(records, ["disease_pattern", "overall_axial_distribution", "overall_manifestation"])
