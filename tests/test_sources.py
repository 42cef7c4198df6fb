"""Readers, writers and streams over real files."""

import numpy as np
import pytest

from driver_checks.block_sources import encoded
from voxtable.operators import annotations as an
from voxtable.schema import AXIAL, FILE_ID, LAYER, LESION, MANIFESTATION
from voxtable.sources import catalog, sinks, volumes
from voxtable.sources.annotations import read_annotations, read_case_records
from voxtable.streaming.arrivals import process_arrivals


def annotation_file(folder, header, *rows):
    path = folder / "labels.csv"
    path.write_text("\n".join([",".join(header), *[",".join(r) for r in rows]]) + "\n", encoding="utf-8")
    return str(path)


def test_annotation_roll_up(spark, tmp_path):
    path = annotation_file(
        tmp_path, [FILE_ID, LAYER, AXIAL, MANIFESTATION, LESION],
        ("UIP 5", "12", "中心", "胸膜下", "蜂窝"), ("UIP 5", "3", "外周", "胸膜下", "网格"), ("UIP 5", "", "外周", "", "蜂窝"),
        ("UIP 5", "3", "中心", "未知词", ""), ("", "9", "外周", "", ""), ("１２", "1", "", "", ""),
    )
    rows = read_annotations(spark, path)
    records = an.case_records(rows)
    got = {r.filename: r for r in records.collect()}
    first = got["UIP 5"]
    assert first.disease_pattern == "UIP"
    # Two against two: the term seen first wins.
    assert (first.overall_axial_distribution, first.overall_manifestation) == ("central", "subpleural")
    assert first.abnormal_manifestation_presence == [1, 1, 0, 0]
    assert first.roi_layers == [2, 2, 11]
    assert first.roi_axial_distributions == ["peripheral", "central", "central"]
    assert first.roi_manifestations == ["subpleural", "未知词", "subpleural"]
    assert got["１２"].disease_pattern == "Unknown" and got["１２"].overall_axial_distribution == "unknown"
    assert an.lesion_mark_counts(rows).first().asDict() == {"honeycombing": 2, "reticulation": 1, "consolidation": 0, "ggo": 0}
    sinks.write_records(records, str(tmp_path / "out"))
    assert sorted(map(str, read_case_records(spark, str(tmp_path / "out")).collect())) == sorted(map(str, records.collect()))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert "未知词" in text


def test_missing_column_fails(spark, tmp_path):
    with pytest.raises(ValueError, match=AXIAL):
        read_annotations(spark, annotation_file(tmp_path, [FILE_ID, LAYER, MANIFESTATION], ("UIP 1", "1", "其他")))


def test_optional_lesion_column(spark, tmp_path):
    rows = read_annotations(spark, annotation_file(tmp_path, [FILE_ID, LAYER, AXIAL, MANIFESTATION], ("UIP 1", "1", "外周", "其他")))
    assert an.lesion_presence(rows).first().abnormal_manifestation_presence == [0, 0, 0, 0]


def test_volume_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    hu = rng.integers(-1000, 400, (3, 4, 5))
    lesion = rng.integers(0, 5, (3, 4, 5))
    (tmp_path / "CT_A 1_0000.nii.gz").write_bytes(encoded(hu, (2.5, 0.5, 0.75)))
    (tmp_path / "CT_B_0000.nii.gz").write_bytes(encoded(hu, (1.0, 1.0, 1.0)))
    (tmp_path / "CT_C_0000.nii.gz").write_bytes(b"not a volume")
    labels = tmp_path / "labels"
    labels.mkdir()
    (labels / "CT_A 1.nii.gz").write_bytes(encoded(lesion, (2.5, 0.5, 0.75)))
    (labels / "CT_B.nii.gz").write_bytes(encoded(lesion[:2], (1.0, 1.0, 1.0)))
    cts = volumes.read_slices(spark, str(tmp_path))
    assert cts.where("error is not null").count() == 1
    cts = cts.transform(catalog.ct_files)
    marked = volumes.read_slices(spark, str(labels)).transform(catalog.lesion_files)
    voxels, cases = volumes.load_cases(cts, marked)
    # B differs in shape, C cannot be read: only A loads.
    assert [tuple(r) for r in cases.collect()] == [("A 1", 2.5, 0.5, 0.75, 3, 4, 5)]
    got = {(r.z, r["y"], r["x"]): (r.hu, r.lesion) for r in voxels.collect()}
    assert got == {tuple(c): (int(hu[c]), int(lesion[c])) for c in np.ndindex(hu.shape)}
    names = catalog.list_files(spark, str(labels)).transform(catalog.lesion_files)
    assert sorted(r.case_id for r in catalog.available_cases(names, cts).distinct().collect()) == ["A 1", "B"]


def test_rewriting_masks_replaces_only_their_cases(spark, tmp_path):
    path = str(tmp_path / "masks")
    schema = "case_id string, mask_type string, z int, y int, x int"
    sinks.write_masks(spark.createDataFrame([("a", "lung_mask", 0, 0, 0), ("b", "lung_mask", 0, 0, 0)], schema), path)
    sinks.write_masks(spark.createDataFrame([("b", "lung_mask", 1, 1, 1), ("b", "lung_mask", 2, 1, 1)], schema), path)
    got = spark.read.parquet(path).groupBy("case_id").count().collect()
    assert {r.case_id: r["count"] for r in got} == {"a": 1, "b": 2}


def test_arrivals_are_processed_once(spark, tmp_path):
    inbox, done, state = (tmp_path / n for n in ("inbox", "done", "state"))
    inbox.mkdir()

    def run():
        process_arrivals(spark, str(inbox), str(state), lambda new: new.select("name"), str(done)).awaitTermination()
        return sorted(r.name for r in spark.read.parquet(str(done)).collect())

    (inbox / "CT_1_0000.nii.gz").write_bytes(b"x")
    (inbox / "notes.txt").write_bytes(b"x")
    assert run() == ["CT_1_0000.nii.gz"]
    (inbox / "CT_2_0000.nii.gz").write_bytes(b"x")
    assert run() == ["CT_1_0000.nii.gz", "CT_2_0000.nii.gz"]


def test_writers_make_no_folder_per_case(spark, tmp_path):
    rows = spark.range(500).selectExpr("id as case_id", "'lung_mask' as mask_type", "cast(id % 3 as int) as z", "0 as y", "cast(id as int) as x", "1 as lesion")
    sinks.write_masks(rows.drop("lesion"), str(tmp_path / "masks"))
    sinks.write_slices(rows, str(tmp_path / "slices"))
    sinks.write_case_results(rows.select("case_id", "z"), str(tmp_path / "results"))
    target = sinks.write_relabelled(rows, str(tmp_path / "relabelled"), "2")
    for path in (tmp_path / "masks", tmp_path / "slices", tmp_path / "results", target):
        assert len(list(type(tmp_path)(path).rglob("*[!c]"))) < 60
    assert spark.read.parquet(target).count() == spark.read.parquet(str(tmp_path / "slices")).count() == 500
    assert spark.read.schema("case_id long, z int").json(str(tmp_path / "results")).where("case_id % 3 = z").count() == 500


def test_masks_written_again_replace_one_type_of_a_case(spark, tmp_path):
    path, schema = str(tmp_path / "masks"), "case_id long, mask_type string, z int, y int, x int"
    write = lambda *rows: sinks.write_masks(spark.createDataFrame(list(rows), schema), path)
    held = lambda: sorted((r.case_id, r.mask_type, r.z) for r in spark.read.parquet(path).collect())
    write((1, "lung_mask", 0, 0, 0), (1, "upper_lung", 0, 0, 0), (2, "lung_mask", 0, 0, 0))
    write((3, "lung_mask", 0, 0, 0))
    write((1, "lung_mask", 5, 0, 0), (1, "lung_mask", 6, 0, 0))
    assert held() == [(1, "lung_mask", 5), (1, "lung_mask", 6), (1, "upper_lung", 0), (2, "lung_mask", 0), (3, "lung_mask", 0)]
    write((1, "lung_mask", 7, 0, 0), (3, "lung_mask", 9, 0, 0))
    assert held() == [(1, "lung_mask", 7), (1, "upper_lung", 0), (2, "lung_mask", 0), (3, "lung_mask", 9)]
    assert len([p for p in (tmp_path / "masks").iterdir() if p.name.startswith("part=")]) == 1
