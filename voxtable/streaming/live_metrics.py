"""Training metrics as a stream of step records, kept as a table with the latest row per run and epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxtable.schema import RUN_STEPS

# Fixed value: the state store that need not hold its state in memory.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PROGRESS = "run string, epoch long, steps long, train_loss double, last_step long, first_ts timestamp, last_ts timestamp"


def step_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Step records as they are written (Parquet files)."""
    reader = spark.readStream.schema(RUN_STEPS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def epoch_progress(steps: DataFrame) -> DataFrame:
    """Steps seen, mean loss and time span per run and epoch; works on streams (update mode) and tables."""
    return steps.groupBy("run", "epoch").agg(
        F.count("*").alias("steps"), F.avg("loss").alias("train_loss"), F.max("step").alias("last_step"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def counted_once(steps: DataFrame, delay: str) -> DataFrame:
    """Steps without those that were sent before; one that comes more than ``delay`` of event time after the newest is dropped.

    State holds a step only as long as it can be repeated, and lies on the disks of the executors.
    """
    steps.sparkSession.conf.set(*STORE)
    return steps.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run", "step"])


def live_progress(steps: DataFrame, table: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Keep ``table`` up to date with the progress of the stream ``steps``.

    Each batch writes the rows that changed under its own number, so a repeated batch replaces itself; ``latest`` reads the newest row of
    each run and epoch, and ``compact`` folds the batches into one.
    """
    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")

    return (
        epoch_progress(counted_once(steps, delay))
        .writeStream.outputMode("update").foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest row per run and epoch."""
    columns = [part.split()[0] for part in PROGRESS.split(", ")]
    rows = spark.read.schema(PROGRESS + ", batch long").parquet(table)
    newest = rows.groupBy("run", "epoch").agg(F.max_by(F.struct(*columns[2:]), "batch").alias("row"))
    return newest.select("run", "epoch", "row.*")


def compact(spark: SparkSession, table: str, target: str) -> None:
    """Write the newest rows of ``table`` to ``target``, a table of the same kind with one batch that precedes all later ones."""
    last = spark.read.schema(PROGRESS + ", batch long").parquet(table).agg(F.max("batch")).first()[0]
    latest(spark, table).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={last}")
