"""Exact greedy box suppression (best score first) as rounds over tables, within and between crops.

Boxes whose IoU exceeds the threshold have similar widths, heights and centres, so
they share a cell of a size-aware grid; each box is filed in at most 16 cells.

* Thinning: a box that is the best of all its cells is kept, whatever else happens, and
  suppresses the boxes it overlaps. Such rounds send one row per box and cell, never the
  pairs of a cell; they go on as long as each settles at least half of the open boxes.
* Local winners: the overlapping pairs of the boxes left are listed once. A box without a
  better open partner is kept, its partners go; a box whose better partners have all gone is
  kept. Pairs are dealt by the place of their worse box to units of ``UNIT`` pairs, and a unit
  follows a chain of such decisions as far as it lies inside it, so a chain of n boxes takes
  about n / UNIT rounds instead of n. An image has as many units as its pairs fill.

Both steps decide exactly as a sequential pass by score would. Boxes and their cells are merged, never sent whole.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator, Sequence
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.geometry import box_iou
from voxtable.functions.joins import shuffled
from voxtable.session import written

LOG = logging.getLogger(__name__)
BOX = ["x0", "y0", "x1", "y1"]
#: Pairs that one task decides about at once.
UNIT = 1 << 16


def _filed(boxes: DataFrame, threshold: float) -> DataFrame:
    """Boxes with the grid cells they belong to: two size levels and two cells per axis.

    ``home_x``/``home_y`` mark rows on the box's own level.
    """
    growth = math.log(1 / threshold)

    def level(low: Column, high: Column) -> Column:
        return F.floor(F.log(F.greatest((high - low).cast("double"), F.lit(1e-9))) / growth)

    def places(low: Column, high: Column) -> Column:
        own = level(low, high)

        def at(shift: int, side: int) -> Column:
            # Cells at least twice the largest centre shift between partners of this level.
            size = 2 * (1 - threshold) * F.exp((own + shift + 1) * growth) + 1e-9
            return F.struct(
                (own + shift).alias("level"),
                F.floor(((low + high) / 2 + side * size / 4) / size).alias("cell"),
            )

        return F.array_distinct(F.array(*[at(shift, side) for shift in (0, 1) for side in (-1, 1)]))

    x, y = (F.col("x0"), F.col("x1")), (F.col("y0"), F.col("y1"))
    return (
        boxes.withColumn("across", F.explode(places(*x)))
        .withColumn("down", F.explode(places(*y)))
        .withColumns({"home_x": F.col("across.level") == level(*x), "home_y": F.col("down.level") == level(*y)})
    )


CELL = ["group", "across", "down"]


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*CELL, *[F.col(c).alias(f"{prefix}{c}") for c in ["id", *BOX, "rank", "home_x", "home_y"]])


def _overlaps(threshold: float, prefix: str) -> Column:
    return box_iou([F.col(c) for c in BOX], [F.col(f"{prefix}{c}") for c in BOX]) > threshold


def _thin(open_boxes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One round by best-of-cell: (kept, still open)."""
    filed = _filed(open_boxes, threshold)
    best = filed.groupBy(*CELL).agg(F.max("rank").alias("best"))
    kept = (
        filed.join(shuffled(best), CELL)
        .groupBy("group", "id", *BOX, "rank")
        .agg(F.every(F.col("rank") == F.col("best")).alias("wins"))
        .where("wins")
        .drop("wins")
    )
    kept = written(kept, "kept")
    near = filed.join(shuffled(_prefixed(_filed(kept, threshold), "k_")), CELL)
    gone = near.where((F.col("k_id") == F.col("id")) | _overlaps(threshold, "k_")).select("group", "id")
    return kept, written(open_boxes.join(shuffled(gone), ["group", "id"], "left_anti"), "open")


def _pairs(open_boxes: DataFrame, threshold: float) -> DataFrame:
    """Overlapping pairs with the rank of the better box and the place of the worse one on a curve through the plane."""
    # Few rows make many comparisons here, so the number of tasks must not follow the row volume.
    tasks = int(open_boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = _filed(open_boxes, threshold).repartition(tasks, *CELL)
    iou = box_iou([F.col(c) for c in BOX], [F.col(f"k_{c}") for c in BOX])
    # Partners meet on the level of the larger one, where at least one of them is at home.
    meet = (F.col("home_x") | F.col("k_home_x")) & (F.col("home_y") | F.col("k_home_y"))
    edge = open_boxes.agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("side")).first()
    side = float(edge.side or 1) or 1.0
    at = [F.floor(((F.col(low) + F.col(high)) / 2 - F.lit(float(start or 0))) / F.lit(side) * 65535).cast("long") for low, high, start in (("x0", "x1", edge.x), ("y0", "y1", edge.y))]
    return (
        filed.join(shuffled(_prefixed(filed, "k_")), CELL)
        .where((F.col("k_rank") > F.col("rank")) & meet)
        .where(iou > threshold)
        .select("group", F.col("k_id").alias("better"), F.col("id").alias("worse"), F.col("k_rank").alias("better_rank"), "rank",
                _spread(at[0]).bitwiseOR(F.shiftleft(_spread(at[1]), 1)).alias("place"))
        .dropDuplicates(["group", "better", "worse"])
    )


def _spread(value: Column) -> Column:
    """16 bits with a gap after each: two such numbers interleaved follow a curve that keeps neighbours close."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One unit: (group, id, kept) of the boxes whose fate follows from winners and from boxes of the unit.

    Rows (group, worse, better, wins) come best ``rank`` first, so the better boxes of the unit are settled before those they overlap.
    """
    fate: dict = {}
    out: list = []
    unit = list(batches)
    table = [zip(*(c.to_pylist() for c in b.columns)) for b in unit]
    for (group, box), rows in groupby(chain.from_iterable(table), key=lambda r: r[:2]):
        states = [True if wins else fate.get((group, better)) for _, _, better, wins in rows]
        kept = False if True in states else None if None in states else True
        if kept is not None:
            fate[group, box] = kept
            out.append((group, box, kept))
    if out:
        kinds = [unit[0].schema.field(0).type, unit[0].schema.field(1).type, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["group", "id", "kept"])


def _lost(pairs: DataFrame) -> DataFrame:
    """(group, id) of the boxes suppressed, given the overlapping pairs."""
    kinds = dict(pairs.dtypes)
    schema = f"group {kinds['group']}, id {kinds['worse']}, kept boolean"
    lost, number = None, 0
    while True:
        left = pairs.count()
        LOG.info("suppression round %d: %d pairs", number, left)
        if not left:
            return lost if lost is not None else pairs.select("group", F.col("worse").alias("id"))
        number += 1
        # Betters that are nobody's worse box any more have won.
        open_ = pairs.select("group", F.col("worse").alias("better"), F.lit(False).alias("wins")).distinct()
        marked = pairs.join(shuffled(open_), ["group", "better"], "left").withColumn("wins", F.coalesce("wins", F.lit(True)))
        units = marked.repartitionByRange(max(1, math.ceil(left / UNIT)), "group", "place", "worse").sortWithinPartitions(F.col("rank").desc(), "group", "worse")
        found = written(units.select("group", "worse", "better", "wins").mapInArrow(_decide, schema), "fates")
        gone = found.where("not kept").select("group", "id")
        lost = gone if lost is None else lost.unionByName(gone)
        pairs = pairs.join(shuffled(found.select("group", F.col("id").alias("worse"))), ["group", "worse"], "left_anti")
        pairs = written(pairs.join(shuffled(gone.withColumnRenamed("id", "better")), ["group", "better"], "left_anti"), "pairs")


def _named(boxes: DataFrame, group: str, box_id: str, tie: Sequence[Column]) -> DataFrame:
    # A higher score ranks first; equal scores go by the further ranks, then to the lower id.
    rank = F.struct(F.col("score").cast("double").alias("score"), *(c.alias(f"tie{k}") for k, c in enumerate(tie)), (-F.col(box_id)).alias("tie"))
    return boxes.select(F.col(group).alias("group"), F.col(box_id).alias("id"), *BOX, rank.alias("rank"))


def suppress(boxes: DataFrame, threshold: float, group: str = "image_id", box_id: str = "box_id", tie: Sequence[Column] = ()) -> DataFrame:
    """Boxes kept by greedy suppression within each group.

    Needs ``x0, y0, x1, y1, score`` and a numeric id. Among equal scores the higher ``tie`` comes first, then the lower id.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    named = _named(boxes, group, box_id, tie)
    # A box without area overlaps nothing; of equal boxes with area only the best can stay.
    solid = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    best = named.where(solid).groupBy("group", *BOX).agg(F.max(F.struct("rank", "id")).alias("top"))
    open_boxes = written(best.select("group", F.col("top.id").alias("id"), *BOX, F.col("top.rank").alias("rank")), "open")
    chosen = named.where(~solid).select("group", "id")
    left = open_boxes.count()
    while left:
        before = left
        winners, open_boxes = _thin(open_boxes, threshold)
        chosen = chosen.unionByName(winners.select("group", "id"))
        left = open_boxes.count()
        LOG.info("suppression by best of cell: %d of %d boxes open", left, before)
        if 2 * left > before:
            break
    lost = _lost(written(_pairs(open_boxes, threshold), "pairs"))
    chosen = chosen.unionByName(open_boxes.join(shuffled(lost), ["group", "id"], "left_anti").select("group", "id"))
    return boxes.join(shuffled(chosen.select(F.col("group").alias(group), F.col("id").alias(box_id))), [group, box_id], "left_semi")


def suppress_crops(boxes: DataFrame, crops: DataFrame, within: float, between: float, image: str = "image_id", box_id: str = "box_id") -> DataFrame:
    """Boxes kept within each crop by score, then between the crops of an image, where boxes of smaller crops come first.

    ``boxes`` lie relative to their crop (``crop_x0, crop_y0, crop_x1, crop_y1``), ``crops`` lists the crops of every image; the result has the
    coordinates of the image. Crops of equal area go by their corner, boxes of one crop by score. An image with one crop is done after the first step.
    """
    corner = [f"crop_{c}" for c in BOX]
    crop = F.to_json(F.struct(F.col(image).alias("image"), *corner))
    first = suppress(boxes.withColumn("_crop", crop), within, "_crop", box_id).drop("_crop")
    many = crops.select(image, *corner).distinct().groupBy(image).agg((F.count("*") > 1).alias("_many"))
    moved = first.join(shuffled(many), image, "left").withColumns({c: F.col(c) + F.col(f"crop_{c[0]}0") for c in BOX})
    moved = written(moved.withColumn("_many", F.coalesce("_many", F.lit(False))), "moved")
    area = (F.col("crop_x1") - F.col("crop_x0")) * (F.col("crop_y1") - F.col("crop_y0"))
    ranked = moved.where("_many").withColumn("_score", F.col("score")).withColumn("score", 1 / area.cast("double"))
    best = suppress(ranked, between, image, box_id, (-F.col("crop_x0"), -F.col("crop_y0"), F.col("_score").cast("double")))
    return best.withColumn("score", F.col("_score")).drop("_score").unionByName(moved.where("not _many")).drop("_many")
