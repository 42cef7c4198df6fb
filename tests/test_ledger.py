"""The work ledger: stopped runs, lapsed claims, failures, and recorded times."""

import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from voxtable.plans import ledger, lung_masks

START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def good(batch):
    return batch.select("case_id", (F.col("case_id") != 4).alias("success"), F.when(F.col("case_id") == 4, "bad").alias("error"))


def test_a_stopped_batch_goes_on_where_it_was(spark, tmp_path):
    path, cases, seen = str(tmp_path / "ledger"), spark.range(7).withColumnRenamed("id", "case_id"), []
    now = [START]

    def work(batch):
        seen.append(sorted(r.case_id for r in batch.collect()))
        if len(seen) == 2:
            raise RuntimeError("lost")
        return good(batch)

    ledger.record_failures(spark.createDataFrame([(0, "no files")], "case_id long, error string"), path, "first", START)
    with pytest.raises(RuntimeError):
        ledger.run_batches(cases, path, work, 3, timedelta(minutes=30), "first", lambda: now[0])
    assert seen == [[1, 2, 3], [4, 5, 6]]
    # While the claim holds, nobody else takes those cases.
    now[0] = START + timedelta(minutes=10)
    ledger.run_batches(cases, path, work, 3, timedelta(minutes=30), "second", lambda: now[0])
    assert len(seen) == 2 and ledger.open_cases(cases, path, now[0]).isEmpty()
    now[0] = START + timedelta(minutes=31)
    ledger.run_batches(cases, path, work, 2, timedelta(minutes=30), "third", lambda: now[0], most=1)
    assert seen[2:] == [[4, 5]]
    now[0] += timedelta(seconds=1)
    ledger.run_batches(cases, path, work, 2, timedelta(minutes=30), "third", lambda: now[0])
    got = {r.case_id: (r.state, r.run_id, r.error) for r in ledger.states(spark, path).collect()}
    assert seen[3:] == [[6]]
    assert got == {"0": ("failed", "first", "no files"), **{str(k): ("done", "first", None) for k in (1, 2, 3)}, "4": ("failed", "third", "bad"), **{str(k): ("done", "third", None) for k in (5, 6)}}


def test_recorded_times_agree_with_the_clock(spark, tmp_path):
    voxels = spark.range(2 * 16 * 16).selectExpr("id div 256 as case_id", "0 as z", "cast(id div 16 % 16 as int) as y", "cast(id % 16 as int) as x", "if(abs(id div 16 % 16 - 8) < 5 and abs(id % 16 - 8) < 5, -800, 40) as hu")
    cases = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 1, 16, 16), (1, 1.0, 1.0, 1.0, 1, 16, 16)], "case_id long, sz double, sy double, sx double, nz int, ny int, nx int")
    none = spark.createDataFrame([], "case_id long, mask_type string")
    tables = lung_masks.StoredRun(*(str(tmp_path / n) for n in ("masks", "outcomes", "times")))
    before = time.time()
    for _ in range(2):  # the second time the batch replaces itself
        stored = lung_masks.store_masks(voxels, cases, none, tables, "b", closing=2)
    passed = time.time() - before
    row = spark.read.parquet(tables.times).collect()
    assert len(row) == 1 and row[0].cases == 2 and row[0].voxels == spark.read.parquet(tables.masks).where("mask_type = 'lung_mask'").count() > 0
    assert 0 < row[0].seconds <= passed and abs((row[0].ended - row[0].started).total_seconds() - row[0].seconds) < 2
    summary = lung_masks.mask_summary(stored).first()
    assert summary.processed_cases == 2 and abs(summary.total_seconds - row[0].seconds) < 1e-6
