"""Exact ranks inside groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.functions.draws import SEED, draw_hash
from voxtable.functions.joins import shuffled


def bucketed_rank(rows: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[str]) -> DataFrame:
    """Add ``place`` (from 1) and ``group_size``.

    ``bucket`` must follow ``order``: every row of an earlier bucket precedes every row
    of a later one. Rows are numbered per bucket; bucket counts give the offsets, which
    are merged with the rows where these lie for the numbering.
    """
    groups = list(groups)
    spread = rows.withColumn("_bucket", bucket)
    counts = spread.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *groups, "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("group_size"),
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    return (
        spread.withColumn("_place", F.row_number().over(inside))
        .join(shuffled(offsets), groups + ["_bucket"])
        .withColumn("place", F.col("_offset") + F.col("_place"))
        .drop("_bucket", "_offset", "_place")
    )


def seeded_rank(rows: DataFrame, groups: Sequence[str], key: Column, seed: int | str = SEED, digits: int = 3) -> DataFrame:
    """A seeded shuffle inside each group: ``place`` and ``group_size``.

    ``digits`` hexadecimal digits of the hash make 16^digits buckets per group.
    """
    hashed = rows.withColumn("_hash", draw_hash(key, seed)).withColumn("_key", key.cast("string"))
    ranked = bucketed_rank(hashed, groups, F.substring("_hash", 1, digits), ["_hash", "_key"])
    return ranked.drop("_hash", "_key")
