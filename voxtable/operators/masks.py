"""Mask tables: boxes, run lengths, stability, crops, points, small regions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.functions.geometry import box_iou, near_crop_edge
from voxtable.functions.joins import looked_up, shuffled
from voxtable.operators.components import component_stats, connect, keep_components
from voxtable.operators.suppression import suppress
from voxtable.session import written

BOX = ["x0", "y0", "x1", "y1"]


def appended(*batches: DataFrame) -> DataFrame:
    """Mask batches one after the other; columns match by name."""
    return reduce(DataFrame.unionByName, batches)


def mask_boxes(pixels: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tight corner box per mask, zeros for an empty one."""
    found = pixels.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    return masks.select(*keys).join(shuffled(found), list(keys), "left").fillna(0, BOX)


def padded_boxes(boxes: DataFrame, padding: int = 5) -> DataFrame:
    """Grow boxes on every side within the frame (``ny``, ``nx``)."""
    return boxes.withColumns({
        "x0": F.greatest(F.col("x0") - padding, F.lit(0)),
        "y0": F.greatest(F.col("y0") - padding, F.lit(0)),
        "x1": F.least(F.col("x1") + padding, F.col("nx") - 1),
        "y1": F.least(F.col("y1") + padding, F.col("ny") - 1),
    })


def lung_boxes(voxels: DataFrame, cases: DataFrame, padding: int = 5) -> DataFrame:
    """Padded lung box of every slice with lung, and its overlap with the lesion box of the slice."""
    def box(condition, prefix):
        return [
            F.min(F.when(condition, F.col("x"))).alias(f"{prefix}x0"), F.min(F.when(condition, F.col("y"))).alias(f"{prefix}y0"),
            F.max(F.when(condition, F.col("x"))).alias(f"{prefix}x1"), F.max(F.when(condition, F.col("y"))).alias(f"{prefix}y1"),
        ]

    both = voxels.where((F.col("lung") > 0) | (F.col("lesion") > 0)).groupBy("case_id", "z").agg(
        *box(F.col("lung") > 0, ""), *box(F.col("lesion") > 0, "l_")
    )
    padded = padded_boxes(looked_up(both.where("x0 is not null"), cases.select("case_id", "ny", "nx"), ["case_id"]), padding)
    lesion = [F.col(f"l_{c}") for c in BOX]
    iou = F.when(F.col("l_x0").isNotNull(), box_iou([F.col(c) for c in BOX], lesion))
    return padded.select("case_id", "z", *BOX, iou.alias("lesion_box_iou"))


def run_lengths(pixels: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Column-major run lengths, starting with the background run (0 when the first pixel is set).

    ``masks`` holds the frame height ``h`` and width ``w``. Runs form per image column
    first; a mask is only brought together as runs.
    """
    keys = list(keys)
    column = Window.partitionBy(*keys, "x").orderBy("y")
    in_column = (
        pixels.select(*keys, "x", "y")
        .withColumn("island", F.col("y") - F.row_number().over(column))
        .groupBy(*keys, "x", "island")
        .agg(F.min("y").alias("first"), F.max("y").alias("last"))
        .join(shuffled(masks.select(*keys, "h", "w")), keys)
        .select(*keys, "h", "w", (F.col("x") * F.col("h") + F.col("first")).alias("start"),
                (F.col("x") * F.col("h") + F.col("last")).alias("end"))
    )
    order = Window.partitionBy(*keys).orderBy("start")
    touches = F.col("start") == F.lag("end").over(order) + 1
    runs = (
        in_column.withColumn("opens", F.when(touches, 0).otherwise(1))
        .withColumn("island", F.sum("opens").over(order))
        .groupBy(*keys, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .withColumn("gap", F.col("start") - F.coalesce(F.lag("end").over(order) + 1, F.lit(0)))
    )
    listed = runs.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("start", "gap", (F.col("end") - F.col("start") + 1).alias("length")))).alias("runs"),
        F.max("end").alias("end"),
    )
    rows = masks.select(*keys, "h", "w").join(shuffled(listed), keys, "left")
    body = F.flatten(F.transform("runs", lambda r: F.array(r["gap"], r["length"])))
    rest = F.col("h") * F.col("w") - F.coalesce(F.col("end") + 1, F.lit(0))
    tail = F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))
    counts = F.concat(F.coalesce(body.cast("array<int>"), F.array().cast("array<int>")), tail.cast("array<int>"))
    return rows.select(*keys, "h", "w", counts.alias("counts"))


def run_pixels(rle: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of run-length masks."""
    keys = list(keys)
    past = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = rle.select(*keys, "h", F.posexplode("counts")).withColumn("start", F.coalesce(F.sum("col").over(past), F.lit(0)))
    cells = starts.where((F.col("pos") % 2 == 1) & (F.col("col") > 0)).select(
        *keys, "h", F.explode(F.sequence("start", F.col("start") + F.col("col") - 1)).alias("cell")
    )
    return cells.select(
        *keys, F.pmod("cell", "h").cast("int").alias("y"), F.floor(F.col("cell") / F.col("h")).cast("int").alias("x")
    )


def run_area(rle: DataFrame, keys: Sequence[str]) -> DataFrame:
    odd = F.filter("counts", lambda value, place: place % 2 == 1)
    return rle.select(*keys, F.aggregate(odd, F.lit(0).cast("bigint"), lambda total, value: total + value).alias("area"))


def stability(logits: DataFrame, keys: Sequence[str], threshold: float = 0.0, offset: float = 1.0) -> DataFrame:
    """Pixels above the raised threshold over pixels above the lowered one; null when none is."""
    return logits.groupBy(*keys).agg(
        F.try_divide(F.count_if(F.col("logit") > threshold + offset), F.count_if(F.col("logit") > threshold - offset))
        .alias("stability_score")
    )


def crop_boxes(images: DataFrame, layers: int = 1, overlap_ratio: float = 512 / 1500) -> DataFrame:
    """The full frame and, per layer i, 2ⁱ × 2ⁱ overlapping crops of every image (``h``, ``w``)."""
    leveled = images.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers))))
    n = F.pow(F.lit(2), F.col("layer")).cast("int")
    overlap = F.when(F.col("layer") == 0, 0).otherwise(
        F.floor(F.lit(overlap_ratio) * F.least("h", "w") * (F.lit(2.0) / n))
    )
    rows = (
        leveled.withColumns({"n": n, "overlap": overlap})
        .withColumns({
            "crop_w": F.ceil((F.col("overlap") * (F.col("n") - 1) + F.col("w")) / F.col("n")),
            "crop_h": F.ceil((F.col("overlap") * (F.col("n") - 1) + F.col("h")) / F.col("n")),
        })
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    )
    x0 = (F.col("crop_w") - F.col("overlap")) * F.col("i")
    y0 = (F.col("crop_h") - F.col("overlap")) * F.col("j")
    return rows.select(
        *images.columns, "layer", x0.alias("crop_x0"), y0.alias("crop_y0"),
        F.least(x0 + F.col("crop_w"), F.col("w").cast("bigint")).alias("crop_x1"),
        F.least(y0 + F.col("crop_h"), F.col("h").cast("bigint")).alias("crop_y1"),
    )


def point_grid(crops: DataFrame, per_side: int, scale_per_layer: int = 1) -> DataFrame:
    """Evenly spaced points of every crop, in image coordinates; sparser in deeper layers."""
    n = F.floor(F.lit(per_side) / F.pow(F.lit(scale_per_layer), F.col("layer"))).cast("int")
    rows = (
        crops.withColumn("n", n)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    )
    at_x, at_y = (2 * F.col("i") + 1) / (2 * F.col("n")), (2 * F.col("j") + 1) / (2 * F.col("n"))
    return rows.select(
        *crops.columns, "i", "j", at_x.alias("unit_x"), at_y.alias("unit_y"),
        (F.col("crop_x0") + at_x * (F.col("crop_x1") - F.col("crop_x0"))).alias("point_x"),
        (F.col("crop_y0") + at_y * (F.col("crop_y1") - F.col("crop_y0"))).alias("point_y"),
    )


def uncropped(rows: DataFrame) -> DataFrame:
    """Boxes (and points, where present) of a crop in image coordinates."""
    moves = {c: F.col(c) + F.col(f"crop_{c[0]}0") for c in [*BOX, "x", "y"] if c in rows.columns}
    return rows.withColumns(moves)


def candidate_filter(
    rows: DataFrame, min_iou: float = 0.88, min_stability: float = 0.95, tolerance: float = 20.0
) -> DataFrame:
    """Mask candidates that are good, stable and not cut by their crop; boxes in image coordinates."""
    frame = [F.lit(0), F.lit(0), F.col("w"), F.col("h")]
    crop = [F.col(f"crop_{c}") for c in BOX]
    cut = near_crop_edge([F.col(c) for c in BOX], crop, frame, tolerance)
    return rows.where((F.col("predicted_iou") > min_iou) & (F.col("stability_score") >= min_stability) & ~cut)


def mask_records(rows: DataFrame) -> DataFrame:
    """One nested record per mask: area, box, scores, prompt point, crop."""
    def corner_box(prefix: str):
        x0, y0, x1, y1 = (F.col(f"{prefix}{c}").cast("double") for c in BOX)
        return F.array(x0, y0, x1 - x0, y1 - y0)

    return rows.select(
        "mask_id", F.struct(
            "area", corner_box("").alias("bbox"), "predicted_iou",
            F.array(F.array("point_x", "point_y")).alias("point_coords"), "stability_score",
            corner_box("crop_").alias("crop_box"),
        ).alias("record")
    )


def _boxed(pixels: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frame size and box (``y0`` to ``x1``, null for an empty mask) of each mask."""
    box = pixels.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return masks.select(*keys, "h", "w").join(shuffled(box), list(keys), "left")


def box_complement(pixels: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels that a mask does not cover in its box grown by one pixel (as far as the frame goes): the gaps along its lines."""
    line = [*keys, "y"]
    rows = F.sequence(F.greatest(F.col("y0") - 1, F.lit(0)), F.least(F.col("y1") + 1, F.col("h") - 1))
    lines = boxes.where(F.col("y0").isNotNull()).withColumn("y", F.explode(rows))
    ends = F.array(F.greatest(F.col("x0") - 1, F.lit(0)) - 1, F.least(F.col("x1") + 1, F.col("w") - 1) + 1)
    sides = lines.select(*line, F.explode(ends).alias("x"))
    following = F.lead("x").over(Window.partitionBy(*line).orderBy("x"))
    gaps = pixels.select(*line, "x").unionByName(sides).select(*line, (F.col("x") + 1).alias("first"), (following - 1).alias("last"))
    return gaps.where(F.col("first") <= F.col("last")).select(*line, F.explode(F.sequence("first", "last")).alias("x"))


def _with_true_size(stats: DataFrame) -> DataFrame:
    """Size of each region in the whole frame, and the rectangles outside the box (``beyond``) that belong to it.

    The ring around the box is background and hangs together with all that lies beyond it, in one piece or, where the box spans the
    frame, in two.
    """
    top, bottom, left, right = F.col("y0") > 0, F.col("y1") < F.col("h") - 1, F.col("x0") > 0, F.col("x1") < F.col("w") - 1
    over, under = F.col("min_y") < F.col("y0"), F.col("max_y") > F.col("y1")
    before, behind = F.col("min_x") < F.col("x0"), F.col("max_x") > F.col("x1")
    above_below, beside = top & bottom & ~left & ~right, left & right & ~top & ~bottom

    def band(held, y0, y1, x0, x1):
        fits = held & (y0 <= y1) & (x0 <= x1)
        return F.when(fits, F.struct(y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1")))

    n = lambda c: F.col(c).cast("int")
    zero = F.lit(0)
    leaves = over | under | before | behind
    one = leaves & ~above_below & ~beside
    beyond = F.array_compact(F.array(
        band(over & (above_below | one) | one, zero, n("y0") - 1, zero, n("w") - 1),
        band(under & (above_below | one) | one, n("y1") + 1, n("h") - 1, zero, n("w") - 1),
        band(before & beside | one, n("y0"), n("y1"), zero, n("x0") - 1),
        band(behind & beside | one, n("y0"), n("y1"), n("x1") + 1, n("w") - 1),
    ))
    area = lambda of: F.aggregate(of, F.lit(0).cast("bigint"), lambda a, r: a + (r["y1"] - r["y0"] + 1).cast("bigint") * (r["x1"] - r["x0"] + 1))
    # The part of a rectangle that the grown box holds, and the region's size counts already.
    inner = F.filter(F.transform("beyond", lambda r: F.struct(
        F.greatest(r["y0"], n("y0") - 1).alias("y0"), F.least(r["y1"], n("y1") + 1).alias("y1"),
        F.greatest(r["x0"], n("x0") - 1).alias("x0"), F.least(r["x1"], n("x1") + 1).alias("x1"),
    )), lambda r: (r["y0"] <= r["y1"]) & (r["x0"] <= r["x1"]))
    return stats.withColumn("beyond", beyond).withColumn("size", F.col("size") + area(F.col("beyond")) - area(inner))


def _numeric(rows: DataFrame, key: str) -> str | None:
    """The key if masks with neighbouring values can share a group."""
    return key if dict(rows.dtypes)[key] in ("int", "bigint") else None


def fill_small_holes(pixels: DataFrame, masks: DataFrame, keys: Sequence[str], min_area: int) -> tuple[DataFrame, DataFrame]:
    """Add background regions (8-connected) smaller than ``min_area``; also the masks changed.

    Only the box of a mask, grown by one pixel, is labelled; what lies beyond it is known by its area.
    """
    keys = list(keys)
    boxes = written(_boxed(pixels, masks, keys), "boxes")
    labelled, roots = connect(box_complement(pixels, boxes, keys), keys, ["y", "x"], stacked=_numeric(pixels, keys[-1]))
    stats = component_stats(labelled, roots, keys, ["y", "x"]).join(shuffled(boxes), keys)
    # Three readers follow.
    small = written(_with_true_size(stats).where(F.col("size") < min_area), "small")
    whole = F.array(F.struct(F.lit(0).alias("y0"), (F.col("h") - 1).cast("int").alias("y1"), F.lit(0).alias("x0"), (F.col("w") - 1).cast("int").alias("x1")))
    empty = boxes.where(F.col("y0").isNull() & (F.col("h") * F.col("w") < min_area)).select(*keys, whole.alias("beyond"))
    # Regions that leave the box and are small all the same: their rectangles hold fewer than ``min_area`` pixels.
    outside = small.select(*keys, "beyond").unionByName(empty).select(*keys, F.inline("beyond"))
    outside = outside.select(*keys, F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1").select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    kinds = dict(pixels.dtypes)
    cells = keep_components(labelled, roots, small, keys).select(*keys, "y", "x").unionByName(outside)
    cells = cells.select(*keys, F.col("y").cast(kinds["y"]).alias("y"), F.col("x").cast(kinds["x"]).alias("x")).distinct()
    changed = small.select(*keys).unionByName(empty.select(*keys)).distinct()
    return pixels.select(*keys, "y", "x").unionByName(cells), changed


def drop_small_islands(pixels: DataFrame, keys: Sequence[str], min_area: int) -> tuple[DataFrame, DataFrame]:
    """Drop regions (8-connected) smaller than ``min_area``; if all are, keep the largest."""
    keys = list(keys)
    labelled, roots = connect(pixels, keys, ["y", "x"], stacked=_numeric(pixels, keys[-1]))
    sizes = component_stats(labelled, roots, keys)
    largest = sizes.groupBy(*keys).agg(F.max_by("component", F.struct(F.col("size"), -F.col("component"))).alias("largest"),
                                       F.max("size").alias("top"))
    kept = sizes.join(shuffled(largest), keys).where(
        (F.col("size") >= min_area) | ((F.col("top") < min_area) & (F.col("component") == F.col("largest")))
    )
    changed = sizes.where(F.col("size") < min_area).select(*keys).distinct()
    return keep_components(labelled, roots, kept, keys).select(*keys, "y", "x"), changed


def cleaned_masks(
    pixels: DataFrame, masks: DataFrame, min_area: int, iou_threshold: float, image: str = "image_id", mask: str = "mask_id",
    min_island: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fill holes, drop islands, and suppress boxes that now coincide, untouched masks first.

    ``min_area`` holds for both unless ``min_island`` is given.

    Returns the pixels of the kept masks and one row per kept mask with box and ``changed``.
    """
    keys = [image, mask]
    filled, holed = fill_small_holes(pixels, masks, keys, min_area)
    cleaned, thinned = drop_small_islands(filled, keys, min_area if min_island is None else min_island)
    changed = holed.unionByName(thinned).distinct().withColumn("changed", F.lit(True))
    boxes = mask_boxes(cleaned, masks, keys).join(shuffled(changed), keys, "left").fillna(False, ["changed"])
    # Suppression reads the boxes several times; they take all steps before to compute.
    scored = written(boxes.withColumn("score", F.when(F.col("changed"), 0.0).otherwise(1.0)), "boxes")
    kept = suppress(scored, iou_threshold, group=image, box_id=mask)
    rows = kept.drop("score")
    return cleaned.join(shuffled(rows.select(*keys)), keys, "left_semi"), rows
