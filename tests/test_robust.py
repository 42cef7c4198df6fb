"""Bad input stays local, scratch tables go, and passes stay few."""

import random

import pytest

from voxtable import session
from voxtable.operators import annotations, slices, suppression
from voxtable.operators.components import cell_number
from voxtable.operators.distance import distance_map
from voxtable.operators.graph import linked_components
from voxtable.operators.training_log import best_epochs


def test_clear_scratch_removes_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_folder", lambda _: str(tmp_path))
    assert session.written(spark.range(5), "numbers").count() == 5
    assert any(tmp_path.rglob("*.parquet"))
    session.clear_scratch(spark)
    assert not any(tmp_path.rglob("*.parquet"))


def test_labels_and_cells_out_of_range_raise(spark):
    cases = spark.createDataFrame([("a", 1.0, 1.0, 4, 4)], "case_id string, step_y double, step_x double, len_y int, len_x int")
    rows = lambda *r: spark.createDataFrame(list(r), "case_id string, y int, x int, lesion int")
    run = lambda df: distance_map(df, cases, axes=("y", "x"), carry="lesion").collect()
    assert {(r.y, r.x, r.lesion) for r in run(rows(("a", 1, 1, 255), ("a", 1, 2, 0), ("unlisted", 9, 9, 999)))} == {(1, 1, 255), (1, 2, 0)}
    for bad in (("a", 1, 1, 256), ("a", 1, 1, -1), ("a", 1, 4, 1), ("a", 1, -1, 1), ("a", 1, 1, None)):
        with pytest.raises(Exception, match="do not fit"):
            run(rows(bad))
    with pytest.raises(Exception, match="needs 0 to"):
        spark.createDataFrame([(-1, 0)], "y int, x int").select(cell_number(["y", "x"])).collect()


def test_losses_that_are_missing(spark):
    rows = [("a", 1, 0.5), ("a", 2, None), ("a", 3, float("nan")), ("a", 4, 0.2), ("b", 1, None)]
    got = {r.run: (r.best_epoch, r.best_loss) for r in best_epochs(spark.createDataFrame(rows, "run string, epoch long, val_loss double")).collect()}
    assert got == {"a": (4, 0.2), "b": (None, None)}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_few_passes(spark, tmp_path):
    columns = "row_no long, file_id string, layer int, axial string, manifestation string, lesion string"
    rows = spark.createDataFrame([(1, "UIP 1", 2, "外周", None, "网格")], columns)
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    listing = annotations.file_terms(stored)
    assert exchanges(listing) == 2 and listing._jdf.queryExecution().executedPlan().toString().count("Location") == 1
    spark.range(9).selectExpr("1 as case_id", "id as z", "id as byte").write.parquet(str(tmp_path / "pixels"))
    assert exchanges(slices.unit_slices(spark.read.parquet(str(tmp_path / "pixels")))) == 1


def chain(n):
    """Boxes that overlap their neighbours only, scores falling along the chain."""
    return [(0, i, 6.0 * i, 0.0, 6.0 * i + 10.0, 10.0, float(n - i)) for i in range(n)]


COLUMNS = "image_id long, box_id long, x0 double, y0 double, x1 double, y1 double, score double"


def test_a_long_chain_takes_few_rounds(spark, monkeypatch, caplog):
    """10,000 boxes in units of about a thousand pairs: no unit holds the image, and rounds follow the number of units, not of boxes."""
    monkeypatch.setattr(suppression, "UNIT", 1024)
    with caplog.at_level("INFO", "voxtable.operators.suppression"):
        kept = suppression.suppress(spark.createDataFrame(chain(10_000), COLUMNS), 0.2).select("box_id").collect()
    assert sorted(r.box_id for r in kept) == list(range(0, 10_000, 2))
    rounds = [r.args for r in caplog.records if r.msg.startswith("suppression round")]
    assert 2 < len(rounds) <= 25 and rounds[-1][1] == 0


def test_boxes_of_smaller_crops_come_first(spark):
    rows = [(0, 1, 0, 0, 50, 50, 0.9, 0, 0, 200, 200), (0, 2, 0, 0, 49, 50, 0.2, 0, 0, 100, 100), (0, 3, 60, 60, 90, 90, 0.5, 0, 0, 100, 100),
            (0, 4, 61, 60, 90, 90, 0.4, 0, 0, 100, 100), (0, 5, 0, 0, 30, 30, 0.1, 100, 100, 200, 200), (1, 6, 0, 0, 10, 10, 0.3, 0, 0, 200, 200), (1, 7, 0, 1, 10, 10, 0.2, 0, 0, 200, 200)]
    names = "image_id int, box_id int, x0 int, y0 int, x1 int, y1 int, score double, crop_x0 int, crop_y0 int, crop_x1 int, crop_y1 int"
    boxes = spark.createDataFrame(rows, names)
    got = suppression.suppress_crops(boxes, boxes.select("image_id", "crop_x0", "crop_y0", "crop_x1", "crop_y1"), 0.95, 0.7)
    # Image 0 prefers box 2 of the small crop to box 1; images with one crop are not judged again.
    assert {(r.box_id, r.x0, r.score) for r in got.collect()} == {(2, 0, 0.2), (3, 60, 0.5), (5, 100, 0.1), (6, 0, 0.3), (7, 0, 0.2)}


def test_walks_equal_a_plain_pass(spark):
    rng = random.Random(3)
    rows = [(g, g * 1000 + i, x, y, x + rng.randint(5, 30), y + rng.randint(5, 30), float(rng.randint(0, 20)))
            for g in range(3) for i in range(120) for x, y in [(float(rng.randint(0, 80)), float(rng.randint(0, 80)))]]
    want = set()
    for g in range(3):
        kept = []
        for _, i, a, b, c, d, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[6], r[1])):
            if all((w := max(0, min(c, e[2]) - max(a, e[0])) * max(0, min(d, e[3]) - max(b, e[1]))) / ((c - a) * (d - b) + (e[2] - e[0]) * (e[3] - e[1]) - w) <= 0.3 for e in kept):
                kept.append((a, b, c, d))
                want.add(i)
    got = suppression.suppress(spark.createDataFrame(rows, COLUMNS), 0.3).select("box_id").collect()
    assert {r.box_id for r in got} == want


def test_linked_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 4), (4, 4), (9, 9)] + [(i, i + 1) for i in range(20, 90)]
    got = {r.node: r.root for r in linked_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 20 for i in range(20, 91)}
    assert linked_components(spark.createDataFrame([], "a long, b long")).collect() == []
