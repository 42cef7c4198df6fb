"""Seeded draws that depend on the row key alone, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def draw_hash(key: Column, seed: int | str = SEED) -> Column:
    """32 hexadecimal digits for a key; ordering by them is a seeded shuffle."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def draw_number(key: Column, seed: int | str = SEED) -> Column:
    """A whole number in [0, 2³²)."""
    return F.conv(F.substring(draw_hash(key, seed), 1, 8), 16, 10).cast("bigint")


def draw_unit(key: Column, seed: int | str = SEED) -> Column:
    """A number in [0, 1)."""
    return draw_number(key, seed) / F.lit(4294967296.0)


def draw_element(values: Column, key: Column, seed: int | str = SEED) -> Column:
    """One element of an array, null for an empty one."""
    position = F.when(F.size(values) > 0, F.pmod(draw_number(key, seed), F.size(values)) + 1)
    return F.when(F.size(values) > 0, F.try_element_at(values, position.cast("int")))
