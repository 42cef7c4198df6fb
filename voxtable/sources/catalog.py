"""File catalogs: which cases have which files, and what is wrong with them.

A catalog is a table of file names (``name``), listed by Spark or derived from any
other table. Nothing here opens a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.functions.names import case_of_ct_file, case_of_lesion_file, file_name

# Mask types; the last one is optional.
MASK_TYPES = ["lung_mask", "upper_lung", "lower_lung", "lobe_mask"]


def list_files(spark: SparkSession, folder: str, pattern: str = "*.nii.gz") -> DataFrame:
    """Names, paths and sizes of the files of a folder, without reading their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(file_name(F.col("path")).alias("name"), "path", "length", "modificationTime")


def ct_files(files: DataFrame) -> DataFrame:
    """CT files with their case: everything between ``CT_`` and ``_0000``."""
    name = F.col("name")
    return files.where(name.startswith("CT_") & name.endswith("_0000.nii.gz")).withColumn("case_id", case_of_ct_file(name))


def lesion_files(files: DataFrame) -> DataFrame:
    name = F.col("name")
    return files.where(name.startswith("CT_") & name.endswith(".nii.gz")).withColumn("case_id", case_of_lesion_file(name))


def mask_files(files: DataFrame) -> DataFrame:
    """Mask files with case and mask type."""
    pattern = rf"^CT_(.+)_({'|'.join(MASK_TYPES)})\.nii\.gz$"
    return files.where(F.col("name").rlike(pattern)).withColumns({
        "case_id": F.regexp_extract("name", pattern, 1), "mask_type": F.regexp_extract("name", pattern, 2),
    })


def cases_with_lung_masks(files: DataFrame) -> DataFrame:
    return mask_files(files).where(F.col("mask_type") == "lung_mask").select("case_id")


def available_cases(lesions: DataFrame, cts: DataFrame) -> DataFrame:
    """Cases of lesion files that also have a CT file."""
    return lesions.select("case_id").join(cts, "case_id", "left_semi")


def cases_without_ct(lesions: DataFrame, cts: DataFrame) -> DataFrame:
    return lesions.select("case_id").join(cts, "case_id", "left_anti")


def validated_cases(cts: DataFrame, lesions: DataFrame) -> DataFrame:
    """Existence, shapes and verdict of every case; both catalogs hold ``shape`` (text).

    Catalogs from ``volumes.read_headers`` hold ``spacing`` and ``error`` as well: both spacings are then part of the result, and a file whose
    header cannot be read makes its case invalid.
    """
    read = "spacing" in cts.columns and "spacing" in lesions.columns
    more = lambda side: [F.col("spacing").alias(f"{side}_spacing"), F.col("error").alias(f"{side}_error")] if read else []
    left = cts.select("case_id", F.col("shape").alias("ct_shape"), F.lit(True).alias("has_ct"), *more("ct"))
    right = lesions.select("case_id", F.col("shape").alias("lesion_shape"), F.lit(True).alias("has_lesion"), *more("lesion"))
    rows = left.join(right, "case_id", "full_outer").fillna(False, ["has_ct", "has_lesion"])
    both = F.col("has_ct") & F.col("has_lesion")
    match = both & F.coalesce(F.col("ct_shape") == F.col("lesion_shape"), F.lit(False))
    # Error texts.
    error = F.when(~both, "Missing files")
    if read:
        error = error.when(F.coalesce("ct_error", "lesion_error").isNotNull(), F.coalesce("ct_error", "lesion_error"))
    error = error.when(~match, "Shape mismatch")
    return rows.select(
        "case_id", F.col("has_ct").alias("ct_exists"), F.col("has_lesion").alias("lesion_exists"),
        F.when(both, F.col("ct_shape")).alias("ct_shape"), F.when(both, F.col("lesion_shape")).alias("lesion_shape"),
        match.alias("shape_match"), match.alias("valid"), error.alias("error"), *(["ct_spacing", "lesion_spacing"] if read else []),
    )


def mask_availability(cases: DataFrame, masks: DataFrame) -> DataFrame:
    """One boolean per mask type for every case."""
    found = masks.groupBy("case_id").agg(
        *[F.bool_or(F.col("mask_type") == kind).alias(kind) for kind in MASK_TYPES]
    )
    return cases.select("case_id").join(found, "case_id", "left").fillna(False, MASK_TYPES)


def validated_with_masks(validated: DataFrame, masks: DataFrame) -> DataFrame:
    """Validation plus mask availability and whether any mask exists."""
    rows = validated.join(mask_availability(validated, masks), "case_id")
    anything = F.lit(False)
    for kind in MASK_TYPES:
        anything = anything | F.col(kind)
    return rows.withColumn("has_precomputed_masks", anything)


def expected_types(with_lobes: bool = False) -> list[str]:
    return MASK_TYPES if with_lobes else MASK_TYPES[:3]


def unfinished_cases(cases: DataFrame, masks: DataFrame, with_lobes: bool = False) -> DataFrame:
    """Cases that lack at least one expected mask."""
    wanted = expected_types(with_lobes)
    done = (
        masks.where(F.col("mask_type").isin(wanted))
        .groupBy("case_id")
        .agg(F.countDistinct("mask_type").alias("n"))
        .where(F.col("n") == len(wanted))
    )
    return cases.join(done, "case_id", "left_anti")


def listed_cases(cases: DataFrame, wanted: Sequence[str] | DataFrame | None) -> DataFrame:
    """Cases of a user's list (a short Python list or a table); all of them for none."""
    if wanted is None:
        return cases
    if isinstance(wanted, DataFrame):
        return cases.join(wanted, "case_id", "left_semi")
    return cases.where(F.col("case_id").isin(list(wanted)))


def complete_slices(labels: DataFrame, images: DataFrame, lungs: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Label entries that have both an image and a lung counterpart."""
    return labels.join(images, list(keys), "left_semi").join(lungs, list(keys), "left_semi")


def _verdict(counts: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    issues = F.array_compact(F.array(*[F.when(failed, F.lit(text)) for failed, text in checks]))
    return counts.withColumn("issues", issues).withColumn("setup_valid", F.size("issues") == 0)


def analysis_setup(cts: DataFrame, lesions: DataFrame) -> DataFrame:
    """File counts, available cases, issues and verdict for a case analysis."""
    files = cts.select("case_id", F.lit(1).alias("ct"), F.lit(0).alias("lesion")).unionByName(
        lesions.select("case_id", F.lit(0).alias("ct"), F.lit(1).alias("lesion"))
    )
    per_case = files.groupBy("case_id").agg(F.sum("ct").alias("ct"), F.sum("lesion").alias("lesion"))
    counts = per_case.agg(
        F.coalesce(F.sum("ct"), F.lit(0)).alias("ct_files"),
        F.coalesce(F.sum("lesion"), F.lit(0)).alias("lesion_files"),
        F.coalesce(F.sum(F.when(F.col("ct") > 0, F.col("lesion"))), F.lit(0)).alias("available_cases"),
    )
    # Issue texts.
    return _verdict(counts, [
        (F.col("ct_files") == 0, "CT directory not found"),
        (F.col("lesion_files") == 0, "Lesion directory not found"),
        ((F.col("ct_files") > 0) & (F.col("lesion_files") > 0) & (F.col("available_cases") == 0), "No matching cases found"),
    ])


def mask_setup(cts: DataFrame) -> DataFrame:
    """CT file count, issues and verdict for mask generation."""
    counts = cts.agg(F.count("*").alias("ct_files"))
    # Fixed value: issue text.
    return _verdict(counts, [(F.col("ct_files") == 0, "No CT files found (pattern: CT_*_0000.nii.gz)")])
