"""Plans that must hold at scale: pruned scans, pushed filters, no voxel-level joins."""

import pytest

from driver_checks import fixtures as fx
from conftest import SMALL
from voxtable.operators import depth, distance, lesions, overlap, profile, regions, slices


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("voxels"))
    fx.masked_voxels(spark, SMALL).write.parquet(f"{folder}/voxels")
    fx.cases(spark, SMALL).write.parquet(f"{folder}/cases")
    return spark.read.parquet(f"{folder}/voxels"), spark.read.parquet(f"{folder}/cases")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_regions_scan_once_without_joining_voxels(stored):
    voxels, _ = stored
    text = plan(regions.region_counts(regions.slice_profile(voxels)))
    assert text.count("FileScan") == 1 and "Join" not in text
    assert "ReadSchema: struct<case_id:bigint,z:int,lung:int,lesion:int>" in text
    # Counts are combined before the first shuffle.
    assert "partial_count" in text


def test_lesion_filter_reaches_the_scan(stored):
    voxels, _ = stored
    text = plan(lesions.lesion_counts(voxels))
    assert "GreaterThan(lesion,0)" in text and "ReadSchema: struct<case_id:bigint,lesion:int>" in text


def test_label_pairs_read_three_columns(stored):
    voxels, _ = stored
    assert "ReadSchema: struct<case_id:bigint,z:int,lesion:int>" in plan(profile.slice_label_pairs(voxels))


def test_distance_reads_only_lung(stored):
    voxels, cases = stored
    text = plan(distance.voxel_features(voxels, cases))
    assert "GreaterThan(lung,0)" in text and "hu" not in text.split("ReadSchema")[1].split("\n")[0]
    assert text.count("FlatMapGroupsInArrow") == 2 and text.count("MapInArrow") >= 1


def test_regrid_needs_no_join(stored):
    voxels, _ = stored
    from pyspark.sql import functions as F

    sized = voxels.withColumns({"ny": F.lit(16), "nx": F.lit(20)})
    text = plan(slices.regridded(sized, 24))
    assert "Join" not in text and "Exchange" not in text


def test_no_cross_joins(stored, spark):
    voxels, cases = stored
    histogram = depth.depth_histogram(voxels.selectExpr("case_id", "lesion", "1.0D as dist_mm"))
    compared = overlap.compare(fx.prediction(spark, SMALL), fx.truth(spark, SMALL))
    for df in (
        depth.axial_distribution(histogram, cases), depth.distance_gradient(histogram, cases), depth.subpleural_bands(histogram, cases),
        overlap.class_overlap(compared, fx.slices(spark, SMALL)), slices.windowed(voxels),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
