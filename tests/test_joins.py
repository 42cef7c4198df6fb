"""Tables that grow with voxels are never sent whole, however small the optimizer takes them for."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from driver_checks import fixtures as fx
from driver_checks import queries
from voxtable.functions.joins import looked_up
from voxtable.operators import components, lesions, slices
from voxtable.operators.ranking import seeded_rank
from voxtable.operators.sampling import weighted_draws
from voxtable.sources import slice_tables, volume_source, volumes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sent(df):
    """What the plan sends whole: the text of each broadcast's own branch."""
    out, lines = [], plan(df).split("\n")
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = re.search(r"[A-Z]", line).start()
            branch = [line]
            for other in lines[n + 1:]:
                if not (found := re.search(r"[A-Z]", other)) or found.start() <= depth:
                    break
                branch.append(other)
            out.append("\n".join(branch))
    return out


def exploded(df):
    return [branch for branch in sent(df) if "Generate" in branch and "Aggregate" not in branch]


@pytest.fixture(scope="module")
def voxels(spark):
    return fx.voxels(spark, SMALL)


def test_masks_of_voxels_are_merged(spark):
    df = queries()["a6_masks_of_voxels"](spark, SMALL)
    assert sent(df) == [] and "SortMergeJoin" in plan(df)


def test_stored_slices_are_merged_in_their_buckets(spark, tmp_path):
    rows = spark.range(8).selectExpr("id as case_id", "0 as z", "1 as ny", "1 as nx", "array(1) as cells")
    masks = slice_tables.masks_by_slice(rows.selectExpr("case_id", "z", "'lung_mask' as mask_type", "cells"))
    stored = [slice_tables.store(t, f"{n}_{spark.sparkContext.applicationId.replace('-', '_')}_j", str(tmp_path / n), 2) for n, t in (("ct", rows), ("label", rows), ("mask", masks))]
    df = slice_tables.zipped_voxels(*stored)
    assert sent(df) == [] and "Exchange" not in plan(df) and df.count() == 8


@pytest.mark.parametrize("name", ["b12_percentile_window", "b12_without_positive_values", "c1_lesion_in_lung"])
def test_voxels_are_not_sent_whole(spark, name):
    assert exploded(queries()[name](spark, SMALL)) == []


def test_slices_as_arrays_are_not_sent_whole(spark, voxels):
    df = volume_source.volume_slices(voxels, fx.cases(spark, SMALL), "hu")
    assert [branch for branch in sent(df) if "collect_list" in branch or "Generate" in branch] == []


def test_component_tables_are_merged(spark):
    cells = fx.voxels(spark, SMALL).where("lesion > 0")
    labelled, roots = components.connect(cells, ["case_id", "z"], ["y", "x"], stacked="z")
    assert sent(components.keep_components(labelled, roots, components.component_stats(labelled, roots, ["case_id", "z"]), ["case_id", "z"])) == []


@pytest.mark.parametrize("name", ["g1_slice_split", "g2_case_split", "d43_split_profile", "c10_absent_labels", "g3_label_draw"])
def test_slices_are_not_sent_whole(spark, name):
    """Splits, strata and label sets hold a row per slice; only counts per label may travel."""
    assert [branch for branch in sent(queries()[name](spark, SMALL)) if "case_id" in branch] == []


def test_ranked_rows_are_not_sent_whole(spark):
    rows = spark.range(1000).selectExpr("id", "id % 20 = 0 as background")
    assert sent(seeded_rank(rows, ["background"], F.col("id"))) == []
    assert [branch for branch in sent(weighted_draws(rows, F.col("id"), spark.range(10).withColumnRenamed("id", "draw"))) if "Window" in branch] == []


def test_a_split_profile_reads_voxels_once(spark, monkeypatch):
    from driver_checks import block_sampling

    made, whole = [], block_sampling.training_pairs
    monkeypatch.setattr(block_sampling, "training_pairs", lambda *given: (made.append(given), whole(*given))[1])
    assert queries()["d43_split_profile"](spark, SMALL).count() == 3 and len(made) == 1


def test_boxes_of_a_suppression_are_not_sent_whole(spark, monkeypatch):
    """Neither boxes nor cells nor pairs; chains of boxes need rounds of pairs."""
    from voxtable.operators import suppression

    made, whole = [], suppression.written
    monkeypatch.setattr(suppression, "written", lambda df, name: (made.append((name, sent(df))), whole(df, name))[1])
    chain = spark.range(400).selectExpr("id % 2 as image_id", "id as box_id", "id * 3 as x0", "0 as y0", "id * 3 + 10 as x1", "10 as y1", "-id as score")
    kept = suppression.suppress(chain, 0.2)
    assert [n for n, branches in [*made, ("kept", sent(kept))] if branches] == [] and {"pairs", "fates"} <= {n for n, _ in made}
    corners = ["image_id", "crop_x0", "crop_y0", "crop_x1", "crop_y1"]
    cropped = chain.selectExpr("*", "0 as crop_x0", "0 as crop_y0", "if(box_id % 3 = 0, 700, 2000) as crop_x1", "20 as crop_y1")
    between = suppression.suppress_crops(cropped, cropped.select(*corners).distinct(), 0.2, 0.2)
    assert sent(between) == [] and all(branches == [] for _, branches in made)


def test_boxes_of_cleaned_masks_are_computed_once(spark, monkeypatch):
    from voxtable.operators import masks

    given = []
    monkeypatch.setattr(masks, "suppress", lambda boxes, *a, **b: (given.append(plan(boxes)), boxes)[1])
    cells = fx.voxels(spark, SMALL).where("lesion > 0 and case_id < 5").select("case_id", "z", "y", "x")
    frames = cells.select("case_id", "z").distinct().withColumns({"h": F.lit(fx.NY), "w": F.lit(fx.NX)})
    masks.cleaned_masks(cells, frames, 6, 0.5, "case_id", "z", min_island=4)
    assert "Join" not in given[0] and "FileScan" in given[0]


def test_looked_up_is_an_inner_join(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "k int, v string")
    table = spark.createDataFrame([(1, 10), (3, 30), (1, 11), (None, 5)], "k int, n int")
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    assert sorted(map(tuple, looked_up(rows, table, ["k"]).collect())) == want


def test_voxels_without_a_case_stay_out_of_windows(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 0, 0, 1, 9), (None, 0, 0, 0, 7)], "case_id int, z int, y int, x int, hu int")
    for scaled in (slices.windowed(rows), slices.percentile_windowed(rows)):
        assert scaled.where("case_id is null").count() == 0 and scaled.count() == 2


def test_small_slices_of_a_file_share_a_batch(spark, monkeypatch):
    from driver_checks.block_sources import encoded
    import numpy as np
    import pyarrow as pa

    cells = np.arange(5 * 2 * 3, dtype=np.int16).reshape(5, 2, 3)
    for most, batches in ((1 << 18, [5]), (12, [2, 2, 1]), (1, [1] * 5)):
        monkeypatch.setattr(volumes, "BATCH_CELLS", most)
        taken = []
        files = type("Files", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, f, schema: (taken.append(f), self)[1], "withColumn": lambda self, n, c: self})()
        monkeypatch.setattr(volumes, "file_name", lambda c: c)
        volumes.decode_files(files)
        out = list(taken[0](iter([pa.RecordBatch.from_pylist([{"path": "a", "content": encoded(cells, (1.0, 1.0, 1.0))}])])))
        assert [b.num_rows for b in out] == batches and [v for b in out for r in b.to_pylist() for v in r["cells"]] == cells.ravel().tolist()


def test_state_of_metrics_is_not_held_in_memory(spark):
    from voxtable.streaming import live_metrics

    key = live_metrics.STORE[0]
    spark.conf.unset(key)
    live_metrics.counted_once(spark.createDataFrame([], "run string, step long, ts timestamp"), "1 day")
    assert spark.conf.get(key) == live_metrics.STORE[1]
