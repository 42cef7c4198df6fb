"""Joins that never send voxels, pixels or cells whole through the driver.

The optimizer measures tables by their files: exploded rows count as the rows they came from, and packed columns as their packed size. Such a
guess can be a thousand times too small, so joins of tables that grow with voxels say which side may travel whole, if any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as one side of a join in which both sides are dealt out by key and merged."""
    return rows.hint("merge")


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inner join of ``rows`` with a much smaller stored ``table``; only ``table`` may be sent whole, and only if it is small.

    An inner join takes the side that is guessed smaller; these two joins have no such choice.
    """
    keys = list(keys)
    return rows.join(table.select(*keys), keys, "left_semi").join(table, keys, "left")
