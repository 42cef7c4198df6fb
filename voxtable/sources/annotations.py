"""Annotation file and case-record reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.schema import ANNOTATION_REQUIRED, ANNOTATIONS, AXIAL, CASE_RECORDS, FILE_ID, LAYER, LESION, MANIFESTATION


def _raw(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", False).csv(path)
    missing = [name for name in ANNOTATION_REQUIRED if name not in raw.columns]
    if missing:
        raise ValueError(f"annotation file lacks the columns {missing}; it has {raw.columns}")
    return raw


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """How many values of each column of the annotation CSV do not parse: column, values."""
    raw = _raw(spark, path)
    lost = [(f.name, F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull()) for f in ANNOTATIONS if f.name in raw.columns]
    counts = raw.agg(*[F.count_if(bad).alias(f"n{i}") for i, (_, bad) in enumerate(lost)])
    pairs = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"n{i}").alias("values")) for i, (name, _) in enumerate(lost)])
    return counts.select(F.inline(pairs))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the annotation CSV in the engine's column names, without rows that name no file.

    Fails when a required column is missing; the lesion column is optional. A value that does not
    parse becomes null (``unreadable`` counts them). ``row_no`` is the order of the rows in the
    file (file and offset order across several files).
    """
    raw = _raw(spark, path)
    types = {field.name: field.dataType for field in ANNOTATIONS}
    columns = [
        (F.col(f"`{name}`") if name in raw.columns else F.lit(None)).try_cast(types[name]).alias(alias)
        for name, alias in (
            (FILE_ID, "file_id"), (LAYER, "layer"), (AXIAL, "axial"), (MANIFESTATION, "manifestation"), (LESION, "lesion"),
        )
    ]
    rows = raw.select(F.monotonically_increasing_id().alias("row_no"), *columns)
    return rows.dropna(subset=["file_id"])


def read_case_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_RECORDS).json(path)
