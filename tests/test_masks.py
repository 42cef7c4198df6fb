"""Suppression against a sequential pass, run lengths by round trip."""

import numpy as np
import pytest

from voxtable.operators import masks, suppression
from voxtable.operators.suppression import suppress


def greedy(boxes, threshold):
    kept = []
    for box_id, x0, y0, x1, y1, score in sorted(boxes, key=lambda b: (-b[5], b[0])):
        hit = False
        for _, a0, b0, a1, b1, _ in kept:
            shared = max(min(x1, a1) - max(x0, a0), 0) * max(min(y1, b1) - max(y0, b0), 0)
            whole = (x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) - shared
            hit = hit or (whole > 0 and shared / whole > threshold)
        if not hit:
            kept.append((box_id, x0, y0, x1, y1, score))
    return sorted(b[0] for b in kept)


@pytest.mark.parametrize("threshold,unit", [(0.7, 1 << 16), (0.5, 100), (0.3, 20)])
def test_suppression_is_exact(spark, monkeypatch, threshold, unit):
    monkeypatch.setattr(suppression, "UNIT", unit)
    rng = np.random.default_rng(int(threshold * 10))
    rows, expected = [], []
    for image in range(2):
        boxes = []
        for n in range(60):
            x0, y0 = rng.integers(0, 30, 2)
            w, h = rng.integers(1, 25, 2)
            boxes.append((n, int(x0), int(y0), int(x0 + w), int(y0 + h), float(rng.integers(0, 10)) / 10))
        boxes += [(60 + n, 5, 5, 25, 25, 0.5) for n in range(10)]      # copies
        boxes += [(80 + n, 7, 7, 7, 12, 0.5) for n in range(2)]        # no area
        rows += [(image, *b) for b in boxes]
        expected += [(image, n) for n in greedy(boxes, threshold)]
    df = spark.createDataFrame(rows, "image_id int, box_id int, x0 int, y0 int, x1 int, y1 int, score double")
    got = suppress(df, threshold).select("image_id", "box_id").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_many_copies_of_one_box_leave_one(spark):
    df = spark.range(5000).selectExpr("1 as image_id", "id as box_id", "0 as x0", "0 as y0", "10 as x1", "10 as y1", "0.5D as score")
    assert [r.box_id for r in suppress(df, 0.7).collect()] == [0]


def test_run_lengths_round_trip(spark):
    rng = np.random.default_rng(4)
    images = [rng.random((7, 5)) < d for d in (0.0, 0.3, 0.7, 1.0)]
    images.append(np.zeros((7, 5), bool))
    images[-1][0, 0] = True
    rows = [(n, int(y), int(x)) for n, m in enumerate(images) for y, x in np.argwhere(m)]
    pixels = spark.createDataFrame(rows, "mask_id int, y int, x int")
    frames = spark.createDataFrame([(n, 7, 5) for n in range(len(images))], "mask_id int, h int, w int")
    rle = masks.run_lengths(pixels, frames, ["mask_id"])
    for r in rle.collect():
        assert sum(r.counts) == 35
        flat = images[r.mask_id].T.ravel()
        want, value, run = [], False, 0
        for cell in flat:
            if cell != value:
                want.append(run)
                value, run = cell, 0
            run += 1
        assert r.counts == want + [run]
    back = masks.run_pixels(rle, ["mask_id"]).collect()
    assert sorted((r.mask_id, r["y"], r["x"]) for r in back) == sorted(rows)
    assert {r.mask_id: r.area for r in masks.run_area(rle, ["mask_id"]).collect()} == {n: int(m.sum()) for n, m in enumerate(images)}


def test_islands_all_small_keep_the_largest(spark):
    rows = [(1, 0, 0), (1, 5, 5), (1, 5, 6)]
    kept, changed = masks.drop_small_islands(spark.createDataFrame(rows, "mask_id int, y int, x int"), ["mask_id"], 10)
    assert sorted((r["y"], r["x"]) for r in kept.collect()) == [(5, 5), (5, 6)]
    assert changed.count() == 1


def test_small_holes_equal_brute_force(spark):
    """Boxes inside the frame, at its sides, across it, and empty masks; regions that leave the box count whole."""
    rng = np.random.default_rng(12)
    images = [rng.random((rng.integers(1, 9), rng.integers(1, 9))) < d for d in (0.2, 0.5, 0.8) for _ in range(12)]
    for rows_, columns in ((slice(2, 4), slice(None)), (slice(None), slice(2, 4)), (slice(3, 5), slice(3, 6)), (slice(0, 0), slice(0, 0)), (slice(0, 2), slice(None))):
        images.append(np.zeros((7, 8), bool))
        images[-1][rows_, columns] = True
    for limit in (4, 17, 60):
        want, changed = set(), set()
        for n, m in enumerate(images):
            want |= {(n, int(y), int(x)) for y, x in np.argwhere(m)}
            seen = m.copy()
            for start in np.argwhere(~m):
                if seen[tuple(start)]:
                    continue
                region, todo = [], [tuple(start)]
                seen[tuple(start)] = True
                while todo:
                    y, x = todo.pop()
                    region.append((n, int(y), int(x)))
                    for b in range(max(y - 1, 0), min(y + 2, m.shape[0])):
                        for a in range(max(x - 1, 0), min(x + 2, m.shape[1])):
                            if not seen[b, a]:
                                seen[b, a] = True
                                todo.append((b, a))
                if len(region) < limit:
                    want |= set(region)
                    changed.add(n)
        rows = [(n, int(y), int(x)) for n, m in enumerate(images) for y, x in np.argwhere(m)]
        frames = spark.createDataFrame([(n, *m.shape) for n, m in enumerate(images)], "mask_id int, h int, w int")
        filled, holed = masks.fill_small_holes(spark.createDataFrame(rows, "mask_id int, y int, x int"), frames, ["mask_id"], limit)
        got = [tuple(r) for r in filled.collect()]
        assert set(got) == want and len(got) == len(want)
        assert {r.mask_id for r in holed.collect()} == changed
