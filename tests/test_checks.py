"""The registered queries: all paired with SQL, and a quick selection compared with it."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest

from conftest import SMALL
from driver_checks import oracle_sql, queries
from driver_checks.compare import difference, views
from driver_checks.registry import compose

QUICK = [
    "b1_disease_pattern", "d3_roi_arrays", "d9_sparse_incidence", "c3_validate_cases", "a13_slice_export", "d13_lesion_types", "d17_lung_distribution",
    "d20_axial_distribution", "d23_distance_gradient", "d26_pleural_contact", "f14_differential", "i2_batch_outcomes", "d34_class_dice",
    "e3_clean_labels", "e9_segment_lungs", "g1_slice_split", "h2_early_stop", "a4_volume_ingest", "j2_live_metrics",
]


def test_every_query_has_sql():
    assert queries().keys() == oracle_sql().keys()


@pytest.fixture(scope="module")
def duck():
    return views(SMALL)


def test_every_twin_binds(duck):
    for name, sql in oracle_sql().items():
        duck.execute("explain " + sql)


def test_unknown_expressions_are_errors():
    with pytest.raises(KeyError):
        compose("select 1", "no such name")


def test_entry_works_without_the_corpus_operators(tmp_path):
    """With both folders of the corpus operators and the pipeline gone, all other queries are still listed."""
    root = pathlib.Path(__file__).parents[1]
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    shutil.copy(root / "corpus_pipeline.py", copy)
    listing = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    for gone in (None, copy / "corpus_pipeline.py"):
        if gone:
            gone.unlink()
        out = subprocess.run([sys.executable, "-c", listing], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
        assert out.stdout.split() == [str(len(queries())), str(len(oracle_sql())), "False"], out.stderr


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, duck, name):
    assert difference(queries()[name](spark, SMALL), duck, oracle_sql()[name]) is None


def test_derived_voxels_grow_in_partitions_and_keep_their_labels(spark, tmp_path):
    """More rows make more tasks, and a filter on a label does not move below and repeat its rule."""
    from driver_checks import fixtures as fx

    spark.range(5000).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    assert fx.voxels(spark, str(tmp_path)).rdd.getNumPartitions() == 20
    plan = fx.scans(spark, str(tmp_path)).where("hu < -300").select("case_id", "z", "y", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "1500" in line]
    from driver_checks.block_labels import training_pairs

    plan = training_pairs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "1500" in line]


def test_slices_of_a_small_file_are_dealt_to_all_tasks(spark, tmp_path):
    from driver_checks import fixtures as fx

    spark.range(5000).coalesce(1).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    rows = fx.slices(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.count() == 5000 * fx.NZ
