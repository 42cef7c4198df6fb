"""The volume data source, its writer, and slice tables that meet without a shuffle."""

import gzip
import os
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from voxtable.sources import slice_tables, volume_source

SHAPE, SPACING = (6, 4, 5), (2.5, 0.5, 0.75)
CELLS = (np.arange(np.prod(SHAPE)).reshape(SHAPE) - 30).astype("<i2")


@pytest.fixture
def folder(tmp_path):
    """Two plain files, a packed one, a mask, one cut short, and one that is no volume."""
    raw = volume_source.header_bytes(SHAPE, SPACING) + CELLS.tobytes()
    for name, content in {
        "CT_a_0000.nii": raw, "CT_b_0000.nii": raw, "CT_a.nii.gz": gzip.compress(raw), "CT_a_lung_mask.nii.gz": gzip.compress(raw),
        "CT_c_0000.nii.gz": gzip.compress(raw[:-50]), "CT_d.nii.gz": b"no volume", "notes.txt": b"x",
    }.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def read(folder, filters=(), **options):
    reader = volume_source.VolumeReader({"path": folder, **options})
    list(reader.pushFilters(list(filters)))
    shares = reader.partitions()
    return shares, [row for s in shares for batch in reader.read(s) for row in batch.to_pylist()]


def test_names_tell_case_and_kind():
    assert [volume_source.case_and_kind(n) for n in ("CT_x_1_0000.nii.gz", "CT_x_1.nii", "CT_x_upper_lung.nii.gz", "x.nii")] == [
        ("x_1", "ct"), ("x_1", "label"), ("x", "upper_lung"), (None, None)]


def test_headers_take_348_bytes_a_file(folder, monkeypatch):
    seen = []
    monkeypatch.setattr(volume_source._Source, "at", lambda self, place, size, at=volume_source._Source.at: (seen.append((self.packed, size)), at(self, place, size))[1])
    _, rows = read(folder, headersonly="true")
    good = {r["name"] for r in rows if r["error"] is None}
    assert good == {"CT_a_0000.nii", "CT_b_0000.nii", "CT_a.nii.gz", "CT_a_lung_mask.nii.gz", "CT_c_0000.nii.gz"}
    assert all((r["nz"], r["sy"], r["cells"]) == (6, 0.5, None) for r in rows if r["error"] is None)
    assert [size for packed, size in seen if not packed] == [348, 348] and sum(size for packed, size in seen if packed) <= 4 * 1024


def test_slabs_read_only_their_slices(folder, monkeypatch):
    taken = []
    monkeypatch.setattr(volume_source._Source, "at", lambda self, place, size, at=volume_source._Source.at: (taken.append(size), at(self, place, size))[1])
    shares, rows = read(folder, [EqualTo(("kind",), "ct"), In(("case_id",), ("a", "b")), GreaterThanOrEqual(("z",), 2), LessThan(("z",), 5)], slabbytes="250")
    # Files of 592 bytes in slabs of 250: three shares each, by themselves.
    assert [len(s.files) for s in shares] == [1] * 6
    assert sorted((r["case_id"], r["z"]) for r in rows) == [(c, z) for c in "ab" for z in (2, 3, 4)]
    assert all(r["cells"] == CELLS[r["z"]].ravel().tolist() for r in rows)
    assert sum(taken) == 6 * 348 + 6 * 40


def test_bad_files_are_rows_of_their_own(spark, folder):
    got = volume_source.read_volumes(spark, folder)
    errors = {r.name: r.error for r in got.where("error is not null").collect()}
    assert set(errors) == {"CT_c_0000.nii.gz", "CT_d.nii.gz"} and "EOF" in errors["CT_c_0000.nii.gz"]
    whole = got.where("error is null and name <> 'CT_c_0000.nii.gz'").groupBy("name").agg(F.count("*").alias("n"), F.sum(F.aggregate("cells", F.lit(0), lambda s, v: s + v)).alias("sum"))
    assert {(r.name, r.n, r["sum"]) for r in whole.collect()} == {(n, 6, int(CELLS.sum())) for n in ("CT_a_0000.nii", "CT_b_0000.nii", "CT_a.nii.gz", "CT_a_lung_mask.nii.gz")}
    assert got.where("case_id = 'b' and z = 3").select("z").collect()[0].z == 3


SLICE = "name string, z int, nz int, ny int, nx int, sz double, sy double, sx double, cells array<int>, error string"


def slices(*rows):
    return [(n, z, 2, 1, 3, 1.0, 1.0, 1.0, cells, error) for n, z, cells, error in rows]


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = slices(("CT_a.nii.gz", 1, [4, 5, 5], None), ("CT_a.nii.gz", 0, [1, 2, 3], None), ("CT_b.nii.gz", 1, [1, 1, 1], None), ("CT_c.nii", 0, [1, 2, 70000], None),
                  ("CT_c.nii", 1, [1, 2, 7], None), ("CT_d.nii", None, None, "unreadable"))
    out = volume_source.relabel_files(spark.createDataFrame(rows, SLICE), str(tmp_path / "out"), {3: 2, 4: 3, 5: 4})
    got = {r.name: r for r in out.collect()}
    assert {n: r.success for n, r in got.items()} == {"CT_a.nii.gz": True, "CT_b.nii.gz": False, "CT_c.nii": False, "CT_d.nii": False}
    assert (got["CT_a.nii.gz"].voxels, got["CT_a.nii.gz"].changed) == (6, 4)
    assert got["CT_a.nii.gz"].before == {"1": 1, "2": 1, "3": 1, "4": 1, "5": 2} and got["CT_a.nii.gz"].after == {"1": 1, "2": 2, "3": 1, "4": 2}
    assert sorted(os.listdir(tmp_path / "out")) == ["CT_a.nii.gz", "outcomes"]
    back = volume_source.read_volumes(spark, str(tmp_path / "out")).orderBy("z").collect()
    assert [r.cells for r in back] == [[1, 2, 2], [3, 4, 4]]
    totals = volume_source.outcome_totals(out).first()
    assert (totals.total_files, totals.successful_files, totals.failed_files, totals.total_converted) == (4, 1, 3, 4)


def test_lost_attempts_and_aborts_leave_nothing(tmp_path):
    """Two attempts of one task write; the commit knows one of them. An abort clears what was staged."""
    writer = volume_source.VolumeWriter({"path": str(tmp_path)})
    batch = pa.RecordBatch.from_pylist([dict(zip(("name", "z", "nz", "ny", "nx", "sz", "sy", "sx", "cells", "error"), r)) for r in slices(("CT_a.nii", 0, [1, 2, 3], None), ("CT_a.nii", 1, [1, 2, 3], None))])
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.files[0][0] != kept.files[0][0]
    writer.commit([kept, None])
    assert sorted(os.listdir(tmp_path)) == ["CT_a.nii", "outcomes"]
    other = volume_source.VolumeWriter({"path": str(tmp_path / "b")})
    other.write(iter([batch]))
    other.abort([None])
    assert os.listdir(tmp_path / "b") == []


def test_stored_slices_meet_without_a_shuffle(spark, tmp_path):
    table = spark.range(40).selectExpr("id % 4 as case_id", "cast(id div 4 as int) as z", "2 as ny", "3 as nx", "array(1, 2, 3, 4, 5, cast(id as int)) as cells")
    masks = table.where("case_id < 3 and z > 1").selectExpr("case_id", "z", "explode(array('lung_mask', 'upper_lung')) as mask_type", "if(z = 2, array(1), array(0, 1, 0, 1, 0, 1)) as cells")
    name = lambda n: f"{n}_{uuid.uuid4().hex}"
    stored = [slice_tables.store(df, name(n), str(tmp_path / n), 4) for n, df in (("ct", table), ("label", table), ("mask", slice_tables.masks_by_slice(masks)))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        voxels = slice_tables.zipped_voxels(*stored)
        plan = voxels._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        assert plan.index("Generate") < plan.index("SortMergeJoin")  # printed from the top: voxels appear after the arrays met
        got = voxels.groupBy("case_id", "z").agg(F.sum("lung").alias("lung"), F.sum("upper").alias("upper"), F.sum("lobe").alias("lobe"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(c, z): (3, 3) if c < 3 and z > 2 else (0, 0) for c in range(4) for z in range(10)}
    assert {(r.case_id, r.z): (r.lung, r.upper) for r in got} == want and all((r.lobe, r.n) == (0, 6) for r in got)


def test_many_slabs_share_tasks(folder, monkeypatch):
    monkeypatch.setattr(volume_source, "SHARES", 2)
    shares, rows = read(folder, [EqualTo(("kind",), "ct"), In(("case_id",), ("a", "b"))], slabbytes="250")
    assert [len(s.files) for s in shares] == [3, 3]
    assert sorted((r["case_id"], r["z"]) for r in rows) == [(c, z) for c in "ab" for z in range(6)]


def test_outcome_rows_stay_in_files_of_the_tasks(tmp_path):
    writer = volume_source.VolumeWriter({"path": str(tmp_path)})
    columns = ("name", "z", "nz", "ny", "nx", "sz", "sy", "sx", "cells", "error")
    sent = [writer.write(iter([pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in slices((f"CT_{n}.nii", 0, [1, 2, 3], None), (f"CT_{n}.nii", 1, [1, 2, 3], None))])])) for n in "ab"]
    assert all(isinstance(value, str) for message in sent for value in vars(message).values())
    writer.commit(sent)
    assert len(os.listdir(tmp_path / "outcomes")) == 2 and {"CT_a.nii", "CT_b.nii"} < set(os.listdir(tmp_path))
