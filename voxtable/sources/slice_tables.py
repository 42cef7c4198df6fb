"""Slices of CT, labels and masks in buckets, so that they meet without a shuffle.

A slice is one row with its cells as an array. Tables with the same number of buckets by (case_id, z) are joined where they lie; voxel rows
appear only after the arrays of a slice have met, so no voxel ever crosses the network, and a large case is spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.joins import shuffled

KEYS = ["case_id", "z"]
# Mask columns of a voxel and the mask type they come from.
SIDES = {"lung": "lung_mask", "upper": "upper_lung", "lower": "lower_lung", "lobe": "lobe_mask"}


def store(slices: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write slices as the table ``name`` under ``path`` in ``buckets`` buckets, and return the table. One file per bucket keeps them sorted."""
    spread = slices.repartition(buckets, *KEYS)
    spread.write.mode("overwrite").option("path", path).bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(name)
    return slices.sparkSession.table(name)


def masks_by_slice(masks: DataFrame) -> DataFrame:
    """One row per slice with an array for each kind of mask, from rows (case_id, z, mask_type, cells)."""
    return masks.groupBy(*KEYS).agg(*(F.max(F.when(F.col("mask_type") == kind, F.col("cells"))).alias(side) for side, kind in SIDES.items()))


def zipped(cts: DataFrame, labels: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Slices of the cases whose CT and label slices have one size: case_id, z, ny, nx, hu, lesion and the mask arrays, zero where absent."""
    size = ["ny", "nx"]
    right = labels.select(*KEYS, F.col("ny").alias("ly"), F.col("nx").alias("lx"), F.col("cells").alias("lesion"))
    # Not as equations, which would become keys of the join and take it away from the buckets.
    both = cts.select(*KEYS, *size, F.col("cells").alias("hu")).join(shuffled(right), KEYS).where("abs(ny - ly) + abs(nx - lx) = 0").drop("ly", "lx")
    if masks is not None:
        both = both.join(shuffled(masks.select(*KEYS, *SIDES)), KEYS, "left")

    def mask(side: str) -> Column:
        zero = F.array_repeat(F.lit(0), F.size("hu"))
        if masks is None:
            return zero.alias(side)
        # A mask of another size says nothing about this slice.
        fits = F.size(side) == F.size("hu")
        return F.when(fits, F.transform(side, lambda v: (v > 0).cast("int"))).otherwise(zero).alias(side)

    return both.select(*KEYS, *size, "hu", "lesion", *(mask(s) for s in SIDES))


def zipped_voxels(cts: DataFrame, labels: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Dense voxels (case_id, z, y, x, hu, lesion, lung, upper, lower, lobe) of slices that met as arrays."""
    columns = ["hu", "lesion", *SIDES]
    rows = zipped(cts, labels, masks).select(*KEYS, "nx", F.posexplode(F.arrays_zip(*columns)).alias("at", "v"))
    return rows.select(*KEYS, F.floor(F.col("at") / F.col("nx")).cast("int").alias("y"), F.pmod("at", "nx").alias("x"), *(F.col(f"v.{c}").alias(c) for c in columns))
