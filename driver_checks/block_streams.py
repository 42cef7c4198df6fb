"""Checks of the streaming jobs, run to completion over files derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.block_sources import volume_files
from driver_checks.block_spatial import CLOSING
from driver_checks.common import fresh
from driver_checks.registry import check
from voxtable.functions.names import file_name
from voxtable.session import written
from voxtable.streaming import arrivals, live_metrics

FILES = "path string, modificationTime timestamp, content binary"


def arrived(spark, folder, name):
    """A CT file per case, label files in two deliveries; every third case never gets one, one of eleven gets a broken one."""
    inbox, state = fresh(spark, "inbox"), fresh(spark, "state")
    tables = arrivals.ArrivalTables.under(fresh(spark, name))
    cts = volume_files(spark, folder, "hu", "/in/CT_%s_0000.nii.gz", scans=True)

    def labels(half):
        """Only the label files of a delivery are made."""
        files = volume_files(spark, folder, "lesion", "/in/CT_%s.nii.gz", f"case_id % 3 <> 0 and case_id % 2 = {half}")
        return files.withColumn("content", F.expr(r"if(regexp_extract(path, 'CT_(\\d+)', 1) % 11 = 5, unbase64('bm8gdm9sdW1l'), content)"))

    # The last delivery only moves the clock on: files that are still missing then count as missing.
    clock = spark.createDataFrame([("/in/CT_clock_0000.nii.gz", None)], "path string, content binary")
    for minutes, files in ((0, cts.unionByName(labels(0))), (30, labels(1)), (300, clock)):
        at = F.timestamp_seconds(F.lit(1_600_000_000 + 60 * minutes)).alias("modificationTime")
        files.select("path", at, "content").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(FILES).parquet(inbox).select(file_name(F.col("path")).alias("name"), "path", "modificationTime")
        store = spark.read.schema(FILES).parquet(inbox).select("path", "content")
        arrivals.segment_arrivals(stream, state, tables, 3600, lambda paths: store.join(paths, "path", "left_semi"), closing=CLOSING).awaitTermination()
    return tables


@check("j1_segmented_arrivals", """select s_suppkey as case_id, ready as success, false as skipped, case when s_suppkey % 3 = 0 then 'no label file' when s_suppkey % 11 = 5 then 'unreadable' end as error,
       case when ready then round(n*sz*sy*sx, 6) end as total_volume_mm3, case when ready then n end as lung_voxels, case when ready then upper end as upper_voxels
       from (select *, s_suppkey % 3 <> 0 and s_suppkey % 11 <> 5 as ready from supplier) join cases on case_id = s_suppkey
       left join (select case_id, count(*) filter (mask_type = 'lung_mask') as n, nullif(count(*) filter (mask_type = 'upper_lung'), 0) as upper from mask_rows group by all) using (case_id)""", "cases", "mask_rows")
def _(spark, folder):
    tables = arrived(spark, folder, "arrivals")
    stored = spark.read.parquet(tables.masks).groupBy("case_id").pivot("mask_type", ["lung_mask", "upper_lung"]).count()
    rows = arrivals.outcomes(spark, tables).where("case_id <> 'clock'").join(stored.withColumn("case_id", F.col("case_id").cast("string")), "case_id", "left")
    return rows.select(
        F.col("case_id").cast("bigint").alias("case_id"), "success", "skipped", F.expr("if(error like '%Error%', 'unreadable', error)").alias("error"), "total_volume_mm3",
        F.col("lung_mask").alias("lung_voxels"), F.col("upper_lung").alias("upper_voxels"))


@check("j2_live_metrics", "select run, epoch, count(*) as steps, round(avg(loss), 6) as train_loss, max(step) as last_step from steps group by all", "steps")
def _(spark, folder):
    """Years come one by one; some steps come a year late, some twice, and stray ones three years late do not count."""
    inbox, table, state = fresh(spark, "steps"), fresh(spark, "progress"), fresh(spark, "state")
    steps = written(fx.run_steps(spark, folder).select("run", "epoch", "step", F.col("ts").cast("timestamp").alias("ts"), "loss", "failed", "o_orderkey"), "steps")
    year = F.year("ts")
    late = steps.withColumn("due", year + (F.col("o_orderkey") % 50 == 0).cast("int"))
    again = steps.where("o_orderkey % 70 = 0").withColumn("due", year + 1)
    stray = steps.where("o_orderkey % 90 = 0").withColumn("due", year + 3).withColumns({"step": -F.col("step"), "loss": F.lit(1000.0)})
    fed = late.unionByName(again).unionByName(stray)
    last = steps.agg(F.max(year)).first()[0]
    for due in range(steps.agg(F.min(year)).first()[0], last + 1):
        # A delivery after the last year would have no newer step beside it.
        fed.where(F.least("due", F.lit(last)) == due).where((F.col("step") > 0) | (F.col("due") <= last)).drop("due", "o_orderkey").write.mode("append").parquet(inbox)
        live_metrics.live_progress(live_metrics.step_stream(spark, inbox), table, state, "400 days").awaitTermination()
    return live_metrics.latest(spark, table).drop("first_ts", "last_ts")
