"""Training slices: windowing over a volume or slice, cleaning, regridding, export order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.functions.intensity import byte_scaled, clipped, ct_window, unit_scaled
from voxtable.functions.joins import shuffled
from voxtable.functions.labels import training_label
from voxtable.functions.names import export_name


def _of_case(voxels: DataFrame, limits: DataFrame) -> DataFrame:
    """Voxels with the row that ``limits`` holds for every case; as an outer join it cannot send the voxels whole."""
    return voxels.where(F.col("case_id").isNotNull()).join(limits, "case_id", "left")


def windowed(voxels: DataFrame, level: float = 40, width: float = 400, volumes: DataFrame | None = None) -> DataFrame:
    """CT window, then min-max of the whole volume to 0..255 in column ``byte``.

    ``volumes`` holds the whole volumes if ``voxels`` are a part of them.
    """
    value = ct_window(F.col("hu"), level, width)
    limits = (voxels if volumes is None else volumes).groupBy("case_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return _of_case(voxels, limits).withColumn("byte", byte_scaled(value, F.col("low"), F.col("high"))).drop("low", "high")


def percentile_windowed(voxels: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Window for other modalities: clip to percentiles of the positive values; zero stays zero.

    A case without a positive value has no window: its other voxels get null.
    """
    hu = F.col("hu")
    positive = voxels.where(hu > 0).groupBy("case_id", "hu").agg(F.count("*").alias("n"))
    bounds = positive.groupBy("case_id").agg(
        F.percentile("hu", F.array(F.lit(low), F.lit(high)), F.col("n")).alias("bounds")
    )
    extremes = voxels.groupBy("case_id").agg(F.min("hu").alias("hu_min"), F.max("hu").alias("hu_max"))
    b0, b1 = F.col("bounds")[0], F.col("bounds")[1]
    # Clipping is monotone, so the extremes of the clipped volume are the clipped extremes.
    limits = extremes.join(bounds, "case_id", "left").select(
        "case_id", "bounds", clipped(F.col("hu_min").cast("double"), b0, b1).alias("low"),
        clipped(F.col("hu_max").cast("double"), b0, b1).alias("high"),
    )
    scaled = byte_scaled(clipped(hu.cast("double"), b0, b1), F.col("low"), F.col("high"))
    return _of_case(voxels, limits).withColumn("byte", F.when(hu == 0, 0).when(F.col("bounds").isNotNull(), scaled)).drop("bounds", "low", "high")


def unit_slices(pixels: DataFrame, value: str = "byte") -> DataFrame:
    """Min-max of every slice to 0..1 in column ``unit``."""
    # A slice is one image, so a window over it brings its pixels together once.
    own = Window.partitionBy("case_id", "z")
    return pixels.withColumn("unit", unit_scaled(F.col(value), F.min(value).over(own), F.max(value).over(own)))


def regridded(pixels: DataFrame, size: int) -> DataFrame:
    """Nearest-neighbour copy onto ``size × size``: destination i reads source floor((i+½)·n/size).

    Each source pixel finds its own destination range, so sparse masks stay sparse and
    nothing is joined. Needs ``ny`` and ``nx``.
    """
    def targets(axis: str):
        position, length = F.col(axis).cast("bigint"), F.col(f"n{axis}").cast("bigint")
        first = F.ceil((2 * size * position - length) / (2 * length))
        last = F.ceil((2 * size * (position + 1) - length) / (2 * length)) - 1
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    rows = pixels.withColumn("_row", F.explode(targets("y"))).withColumn("_column", F.explode(targets("x")))
    return rows.withColumns({"y": F.col("_row").cast("int"), "x": F.col("_column").cast("int")}).drop("_row", "_column", "ny", "nx")


def kept_slices(labels: DataFrame) -> DataFrame:
    """Slices with any label, numbered from 0 per case; a case has at most ``nz`` of them."""
    order = Window.partitionBy("case_id").orderBy("z")
    found = labels.where(F.col("lesion") > 0).select("case_id", "z").distinct()
    return found.withColumn("i", F.row_number().over(order) - 1).withColumn("name", export_name(F.col("case_id"), F.col("i")))


def roi_slices(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """Voxels of the slices whose label slice is not empty."""
    wanted = labels.where(F.col("lesion") > 0).select("case_id", "z").distinct()
    return voxels.join(shuffled(wanted), ["case_id", "z"], "left_semi")


def with_training_labels(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("label", training_label(F.col("lesion"), F.col("lung")).cast("int"))
