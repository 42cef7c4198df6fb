"""Voxel volume, distance classes and box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIPHERAL_MM = 10.0
PERIPHERAL_RATIO = 0.20
SUBPLEURAL_MM = 3.0
CONTACT_MM = 0.5

# Distance bands to the pleura in mm, lower bound included.
BANDS = [
    ("distance_0_1mm", 0.0, 1.0),
    ("distance_1_2mm", 1.0, 2.0),
    ("distance_2_3mm", 2.0, 3.0),
    ("distance_3_5mm", 3.0, 5.0),
    ("distance_5mm_plus", 5.0, None),
]

# Concentric zones in mm, upper bound included.
ZONES = [
    ("zone_1_peripheral", 0.0, 5.0),
    ("zone_2_intermediate", 5.0, 15.0),
    ("zone_3_central", 15.0, None),
]

GRADIENT_BINS = 10


def voxel_volume(sz: Column, sy: Column, sx: Column) -> Column:
    """Volume of a voxel in mm³, 1 when a spacing is missing."""
    return F.coalesce(sz * sy * sx, F.lit(1.0))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def is_peripheral(
    dist: Column, max_radius: Column, limit_mm: float = PERIPHERAL_MM, limit_ratio: float = PERIPHERAL_RATIO
) -> Column:
    """Near the surface in mm, or relative to the deepest point."""
    return (dist <= limit_mm) | (dist <= limit_ratio * max_radius)


def distance_band(dist: Column) -> Column:
    """Number of the band in ``BANDS`` (from 0)."""
    out = F.when(dist < 0, F.lit(None).cast("int"))
    for position, (_, low, high) in enumerate(BANDS):
        inside = dist >= low if high is None else (dist >= low) & (dist < high)
        out = out.when(inside, F.lit(position))
    return out


def concentric_zone(dist: Column) -> Column:
    """Number of the zone in ``ZONES`` (from 0), null outside the lung."""
    out = F.when(dist <= 0, F.lit(None).cast("int"))
    for position, (_, low, high) in enumerate(ZONES):
        inside = dist > low if high is None else (dist > low) & (dist <= high)
        out = out.when(inside, F.lit(position))
    return out


def gradient_bin(dist: Column, max_dist: Column, bins: int = GRADIENT_BINS) -> Column:
    """Equal bins over [0, max), right side open: the maximum itself has no bin."""
    out = F.when((max_dist <= 0) | (dist < 0), F.lit(None).cast("int"))
    for position in range(bins):
        out = out.when(dist < (position + 1) * max_dist / bins, F.lit(position))
    return out


def box_size(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """Corner form to ``x, y, w, h``."""
    return [x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")]


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def box_iou(left: list[Column], right: list[Column]) -> Column:
    """Intersection over union of two corner-form boxes, 0 when the union is empty."""
    width = F.greatest(F.least(left[2], right[2]) - F.greatest(left[0], right[0]), F.lit(0))
    height = F.greatest(F.least(left[3], right[3]) - F.greatest(left[1], right[1]), F.lit(0))
    shared = (width * height).cast("double")
    return ratio(shared, box_area(*left) + box_area(*right) - shared)


def near_crop_edge(
    box: list[Column], crop: list[Column], frame: list[Column], tolerance: float = 20.0
) -> Column:
    """A side lies within ``tolerance`` of the crop edge and not of the image edge."""
    out = F.lit(False)
    for side, crop_side, frame_side in zip(box, crop, frame):
        at_crop = F.abs(side - crop_side) <= tolerance
        at_frame = F.abs(side - frame_side) <= tolerance
        out = out | (at_crop & ~at_frame)
    return out
