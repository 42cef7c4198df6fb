"""A ledger of work: which cases are claimed, done or failed, so that a stopped batch goes on where it was.

The ledger is a table that only grows. A case's state is its latest row. Whoever works on a case claims it for a time; a claim that was never
settled, because its run was stopped, lapses and the case is open again. Batches write their results before they settle, and results are keyed by case, so
a case done twice is stored once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "case_id string, state string, run_id string, claim string, at timestamp, lease_until timestamp, error string"
#: Rank of states with one time: a settled state follows its claim.
_ORDER = {"claimed": 0, "failed": 1, "done": 2}


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the ledger; none before the first."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def states(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of every case."""
    rank = F.create_map(*(F.lit(v) for pair in _ORDER.items() for v in pair))[F.col("state")]
    newest = F.max_by(F.struct("state", "run_id", "at", "lease_until", "error"), F.struct("at", rank.alias("rank")))
    return entries(spark, path).groupBy("case_id").agg(newest.alias("row")).select("case_id", "row.*")


def _append(rows: DataFrame, path: str, run_id: str, at: datetime, claim: str | None = None) -> None:
    stamped = rows.withColumns({"run_id": F.lit(run_id), "claim": F.lit(claim).cast("string"), "at": F.lit(at)})
    stamped.select(*(part.split()[0] for part in LEDGER.split(", "))).write.mode("append").parquet(path)


def open_cases(cases: DataFrame, path: str, now: datetime) -> DataFrame:
    """Cases that nobody settled and nobody holds at ``now``."""
    taken = states(cases.sparkSession, path).where(F.col("state").isin("done", "failed") | (F.col("lease_until") > F.lit(now)))
    name = F.col("case_id").cast("string")
    return cases.withColumn("_name", name).join(taken.select(F.col("case_id").alias("_name")), "_name", "left_anti").drop("_name")


def record_failures(failures: DataFrame, path: str, run_id: str, now: datetime) -> None:
    """Settle cases that cannot be worked on: (case_id, error), for instance those whose files do not pass validation."""
    spark = failures.sparkSession
    known = states(spark, path).where(F.col("state").isin("done", "failed")).select("case_id")
    rows = failures.select(F.col("case_id").cast("string").alias("case_id"), "error").join(known, "case_id", "left_anti")
    _append(rows.withColumns({"state": F.lit("failed"), "lease_until": F.lit(None).cast("timestamp")}), path, run_id, now)


def run_batches(
    cases: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], size: int, lease: timedelta = timedelta(hours=6), run_id: str | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), most: int | None = None,
) -> str:
    """Work through the open cases, ``size`` at a time in the order of ``case_id``, and settle each batch; returns the run's id.

    ``work`` gets the rows of a batch, stores what it makes, and returns (case_id, success, error). Cases it says nothing about stay claimed and
    come back when the lease is over. ``most`` stops the run after so many batches.
    """
    spark = cases.sparkSession
    run_id = run_id or uuid.uuid4().hex
    done = 0
    while most is None or done < most:
        now, mark = clock(), uuid.uuid4().hex
        # As many rows as a batch is told to have.
        batch = open_cases(cases, path, now).orderBy("case_id").limit(size).select("case_id")
        claim = batch.select(F.col("case_id").cast("string").alias("case_id")).withColumns(
            {"state": F.lit("claimed"), "lease_until": F.lit(now + lease), "error": F.lit(None).cast("string")})
        _append(claim, path, run_id, now, mark)
        mine = entries(spark, path).where((F.col("claim") == mark) & (F.col("state") == "claimed")).select("case_id")
        held = cases.withColumn("_name", F.col("case_id").cast("string")).join(mine.withColumnRenamed("case_id", "_name"), "_name", "left_semi").drop("_name")
        if held.isEmpty():
            break
        found = work(held).select(
            F.col("case_id").cast("string").alias("case_id"), F.when(F.col("success"), "done").otherwise("failed").alias("state"), "error")
        _append(found.withColumn("lease_until", F.lit(None).cast("timestamp")), path, run_id, max(now, clock()), mark)
        done += 1
    return run_id
