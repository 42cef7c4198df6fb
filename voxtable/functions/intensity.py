"""Hounsfield windows and rescaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LUNG_THRESHOLD_HU = -300
WINDOW_LEVEL = 40
WINDOW_WIDTH = 400


def below_threshold(hu: Column, threshold: float = LUNG_THRESHOLD_HU) -> Column:
    return hu < threshold


def clipped(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(value, high), low)


def ct_window(hu: Column, level: float = WINDOW_LEVEL, width: float = WINDOW_WIDTH) -> Column:
    """Clip to ``level ± width/2``."""
    return clipped(hu.cast("double"), F.lit(level - width / 2), F.lit(level + width / 2))


def byte_scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max to 0..255, cut to a whole number; a flat volume becomes 0."""
    scaled = F.floor((value - low) / (high - low) * 255.0).cast("int")
    return F.when(high > low, scaled).otherwise(F.lit(0))


def unit_scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max to 0..1 with the range floored at 1e-8."""
    return (value - low) / F.greatest(high - low, F.lit(1e-8))
