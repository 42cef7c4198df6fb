"""Arrivals as a stateful stream, and live metrics, with late and repeated input."""

import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import SMALL
from driver_checks import fixtures as fx
from driver_checks.block_sources import volume_files
from voxtable.sources import volumes
from voxtable.streaming import arrivals, live_metrics

START = datetime.datetime(2024, 5, 1, 12)


@pytest.fixture
def feed(spark, tmp_path):
    """Deliver file names at a minute, and read all that the pairing has sent so far: (case, error) in order of batches."""
    inbox, state, out = (str(tmp_path / n) for n in ("inbox", "state", "out"))

    def deliver(minute, *names):
        rows = [(n, f"/in/{n}", START + datetime.timedelta(minutes=minute)) for n in names]
        spark.createDataFrame(rows, "name string, path string, modificationTime timestamp").coalesce(1).write.mode("append").parquet(inbox)
        files = spark.readStream.schema("name string, path string, modificationTime timestamp").parquet(inbox)
        query = arrivals.paired_cases(files, 3600).writeStream.foreachBatch(
            lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return [(r.case_id, r.ct_path is not None, r.label_path is not None, r.error) for r in spark.read.parquet(out).orderBy("n", "case_id").collect()]

    return deliver


def test_cases_leave_complete_or_late(feed):
    assert feed(0, "CT_a_0000.nii.gz", "CT_b.nii.gz", "CT_c_0000.nii.gz", "CT_c.nii.gz", "CT_a_lung_mask.nii.gz", "notes.txt") == [("c", True, True, None)]
    first = [("c", True, True, None), ("b", True, True, None)]
    assert feed(50, "CT_b_0000.nii.gz") == first
    # The clock moves past the hour that a may wait; c is not sent again although one of its files came twice.
    after = feed(100, "CT_c.nii.gz")
    assert after == [*first, ("a", True, False, "no label file")]
    # A late file still finds its partner.
    assert feed(110, "CT_a.nii.gz") == [*after, ("a", True, True, None)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    tables = arrivals.ArrivalTables.under(str(tmp_path))
    wanted = "case_id <= 2"
    files = volume_files(spark, SMALL, "hu", "/in/CT_%s_0000.nii.gz", wanted, scans=True).unionByName(volume_files(spark, SMALL, "lesion", "/in/CT_%s.nii.gz", wanted))
    files.write.parquet(str(tmp_path / "files"))
    store = spark.read.parquet(str(tmp_path / "files"))
    rows = [("1", "/in/CT_1_0000.nii.gz", "/in/CT_1.nii.gz", None), ("2", "/in/CT_2_0000.nii.gz", "/in/CT_1.nii.gz", None), ("9", None, "/in/CT_9.nii.gz", "no CT file")]
    batch = spark.createDataFrame(rows[:1] + rows[2:], arrivals.CASE_FILES)
    contents = lambda paths: store.join(paths, "path", "left_semi")
    for _ in range(2):
        arrivals.segment_batch(spark, batch, 4, tables, contents, closing=3)
        got = {r.case_id: (r.success, r.skipped, r.error) for r in arrivals.outcomes(spark, tables).collect()}
        assert got == {"1": (True, False, None), "9": (False, False, "no CT file")}
    voxels = spark.read.parquet(tables.masks).count()
    # In a later batch the same case is skipped and its masks stay.
    arrivals.segment_batch(spark, batch, 5, tables, contents, closing=3)
    assert {r.case_id: r.skipped for r in arrivals.outcomes(spark, tables).where("success").collect()} == {"1": True}
    assert spark.read.parquet(tables.masks).count() == voxels > 0


def test_slices_of_a_batch_are_not_joined(spark, tmp_path, monkeypatch):
    """Case and kind come with the file, and masks take the cells of the CT as they lie; only rows per case are joined."""
    tables = arrivals.ArrivalTables.under(str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    files = [volume_files(spark, SMALL, value, name, "case_id in (1, 2)") for value, name in (("hu", "/in/CT_%s_0000.nii.gz"), ("lesion", "/in/CT_%s.nii.gz"))]
    odd = files[1].where("path like '%_2.nii.gz'").select("path", F.unbase64(F.lit("bm8=")).alias("content"))
    files[0].unionByName(files[1].where("path like '%_1.nii.gz'")).unionByName(odd).write.parquet(str(tmp_path / "files"))
    store = spark.read.parquet(str(tmp_path / "files"))
    made, given = {}, []
    whole, masks = arrivals.written, arrivals.generate_masks
    monkeypatch.setattr(arrivals, "written", lambda df, name: (made.update({name: plan(df)}), whole(df, name))[1])
    monkeypatch.setattr(arrivals, "generate_masks", lambda voxels, cases, *a, **b: (given.append((plan(voxels), cases.collect())), masks(voxels, cases, *a, **b))[1])
    batch = spark.createDataFrame([(str(n), f"/in/CT_{n}_0000.nii.gz", f"/in/CT_{n}.nii.gz", None) for n in (1, 2)], arrivals.CASE_FILES)
    arrivals.segment_batch(spark, batch, 0, tables, lambda paths: store.join(paths, "path", "left_semi"), closing=3)
    assert "Join" not in made["decoded"].split("MapInArrow")[0] and "Join" in made["decoded"]
    assert "cells" not in made["cases"]
    (voxels, cases), = given
    assert "Join" not in voxels and [(r.case_id, r.nz, r.ny, r.nx) for r in cases] == [("1", fx.NZ, fx.NY, fx.NX)]
    assert {r.case_id: r.error is None for r in arrivals.outcomes(spark, tables).collect()} == {"1": True, "2": False}


def test_voxels_of_a_file_are_packed_where_they_lie(spark):
    files = volume_files(spark, SMALL, "hu", "/in/CT_%s_0000.nii.gz", scans=True)
    text = files._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in text and text.count("Exchange hashpartitioning") == 1
    back = volumes.slice_voxels(volumes.decode_files(files).withColumn("case_id", F.regexp_extract("name", r"CT_(\d+)", 1).cast("bigint")), "hu")
    given = fx.scans(spark, SMALL).select("case_id", "z", "y", "x", "hu")
    assert given.count() == back.count() and given.exceptAll(back).isEmpty()


def test_a_new_case_asks_the_store_once_before_it_is_kept():
    class Store:
        def __init__(self):
            self.calls, self.kept = [], None

        def __getattr__(self, name):
            return lambda *given: self.calls.append(name)

    store = Store()
    pairing = arrivals._Pairing(1000, 10000)
    pairing.handle = pairing.files = store
    rows = [Row(kind=kind, path=path, at=5) for kind, path in (("ct", "b"), ("ct", "a"), ("label", "l"))]
    assert [r.asDict() for r in pairing.handleInputRows(("7",), iter(rows), None)] == [{"case_id": "7", "ct_path": "a", "label_path": "l", "error": None}]
    assert store.calls == ["get", "update", "registerTimer"]


def test_progress_counts_steps_once_and_late_ones_too(spark, tmp_path):
    inbox, table, state = (str(tmp_path / n) for n in ("inbox", "table", "state"))
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)

    def deliver(*rows):
        steps = [("r", e, s, day(d), loss, False) for e, s, d, loss in rows]
        spark.createDataFrame(steps, live_metrics.RUN_STEPS).coalesce(1).write.mode("append").parquet(inbox)
        live_metrics.live_progress(live_metrics.step_stream(spark, inbox), table, state, "10 days").awaitTermination()
        return {r.epoch: (r.steps, r.train_loss) for r in live_metrics.latest(spark, table).collect()}

    assert deliver((1, 1, 0, 2.0), (1, 2, 1, 4.0), (1, 2, 1, 4.0)) == {1: (2, 3.0)}
    # A repeated step changes nothing; a late one within ten days counts; epoch 1 is not touched by epoch 2.
    assert deliver((1, 1, 0, 2.0), (2, 4, 9, 1.0)) == {1: (2, 3.0), 2: (1, 1.0)}
    assert deliver((1, 3, 2, 6.0)) == {1: (3, 4.0), 2: (1, 1.0)}
    assert deliver((2, 5, 40, 3.0))[2] == (2, 2.0)
    # Thirty days late is too late.
    assert deliver((1, 7, 3, 100.0)) == {1: (3, 4.0), 2: (2, 2.0)}
    live_metrics.compact(spark, table, str(tmp_path / "small"))
    assert live_metrics.latest(spark, str(tmp_path / "small")).count() == 2 and spark.read.parquet(str(tmp_path / "small")).count() == 2


def test_files_of_a_batch_are_read_by_path(spark, tmp_path):
    (tmp_path / "a.nii.gz").write_bytes(b"x")
    (tmp_path / "b.nii.gz").write_bytes(b"y")
    read = arrivals.files_of(spark)
    assert read(spark.createDataFrame([], "path string")).count() == 0
    assert [bytes(r.content) for r in read(spark.createDataFrame([(str(tmp_path / "b.nii.gz"),)], "path string")).collect()] == [b"y"]
    assert fx.NZ  # the phantom's fixtures are importable beside the stream
