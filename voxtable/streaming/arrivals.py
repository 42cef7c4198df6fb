"""New volume files as a stream: a case is segmented once both of its files are there.

The CT and the label file of a case come in any order and at any distance. State per case holds the names seen so far; the case
leaves as soon as it is complete, or as a failure when the event time (the files' modification time) has moved on by ``wait``.
Contents stay where they are until a batch of complete cases is decoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from voxtable.functions.joins import looked_up
from voxtable.functions.names import case_of_ct_file, case_of_lesion_file, file_name
from voxtable.plans.lung_masks import generate_masks
from voxtable.session import written
from voxtable.sources import volumes
from voxtable.sources.sinks import write_masks

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
CASE_FILES = T.StructType([T.StructField(n, T.StringType()) for n in ("case_id", "ct_path", "label_path", "error")])
# Fixed value: the state store that keeps keyed state with timers.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.nii.gz") -> DataFrame:
    """Names and paths of files as they appear; the content stays unread."""
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).load(folder)
    return stream.select(file_name(F.col("path")).alias("name"), "path", "length", "modificationTime")


def process_arrivals(
    spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame],
    done: str, pattern: str = "CT_*_0000.nii.gz",
) -> StreamingQuery:
    """Run ``handle`` on each batch of new files and store its rows under ``done``.

    ``handle`` gets (name, path, ...). The stream's checkpoint remembers the files seen, and a batch
    is stored under its number: one that is repeated after a failure replaces its own rows, so
    nothing stored before is read.
    """
    def step(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{done.rstrip('/')}/batch={number}")

    return (
        arriving_files(spark, folder, pattern)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class _Pairing(StatefulProcessor):
    """Per case: the files seen, whether their absence was reported, and a timer that starts anew with each file."""

    def __init__(self, wait: int, keep: int) -> None:
        self.wait, self.keep = wait, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.files = handle.getValueState("files", "ct string, label string, done boolean, reported boolean")

    def _alarm(self, at: int, first: bool = False) -> None:
        # A case that is seen for the first time has no timer; each question to the store is a call to another process.
        for timer in [] if first else list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = self.files.get()
        ct, label, done, reported = seen or (None, None, False, False)
        last = 0
        for row in rows:
            # Of several files of a kind the first name counts, whatever their order in the batch.
            if row.kind == "ct":
                ct = row.path if ct is None else min(ct, row.path)
            else:
                label = row.path if label is None else min(label, row.path)
            last = max(last, row.at)
        complete = ct is not None and label is not None
        if complete and not done:
            yield Row(case_id=key[0], ct_path=ct, label_path=label, error=None)
        self.files.update((ct, label, complete, reported))
        self._alarm(last + (self.keep if complete or reported else self.wait), seen is None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ct, label, done, reported = self.files.get()
        if done or reported:
            self.files.clear()
            return
        self.files.update((ct, label, False, True))
        self._alarm(expiredTimerInfo.getExpiryTimeInMs() + self.keep)
        yield Row(case_id=key[0], ct_path=ct, label_path=label, error="no CT file" if ct is None else "no label file")

    def close(self) -> None:
        pass


def paired_cases(files: DataFrame, wait_seconds: int, delay: str = "0 seconds", keep_seconds: int | None = None) -> DataFrame:
    """A stream of (case_id, ct_path, label_path, error) from a stream of (name, path, modificationTime).

    A case whose other file does not come within ``wait_seconds`` of event time leaves with ``error``, and once more, complete, if that file comes
    after all within ``keep_seconds`` (ten waits by default), for which a case is remembered. A complete case is sent once, whatever comes again in that
    time. ``delay`` is how far the files of a stream may be out of order. Names of other kinds are passed over.
    """
    files.sparkSession.conf.set(*_STORE)
    is_ct = F.col("name").rlike(r"^CT_.+_0000\.nii\.gz$")
    is_mask = F.col("name").rlike(rf"_({'|'.join(volumes.MASK_TYPES)})\.nii\.gz$")
    rows = files.withWatermark("modificationTime", delay).where(F.col("name").rlike(r"^CT_.+\.nii\.gz$") & (is_ct | ~is_mask)).select(
        F.when(is_ct, case_of_ct_file(F.col("name"))).otherwise(case_of_lesion_file(F.col("name"))).alias("case_id"),
        F.when(is_ct, "ct").otherwise("label").alias("kind"), "path", "modificationTime", F.unix_millis("modificationTime").alias("at"),
    )
    return rows.groupBy("case_id").transformWithState(_Pairing(1000 * wait_seconds, 1000 * (keep_seconds or 10 * wait_seconds)), CASE_FILES, "append", "EventTime")


class ArrivalTables(NamedTuple):
    """Folders of a segmentation stream: masks by case and type, and one row per case and batch."""

    masks: str
    outcomes: str

    @classmethod
    def under(cls, folder: str) -> "ArrivalTables":
        return cls(f"{folder.rstrip('/')}/masks", f"{folder.rstrip('/')}/outcomes")


OUTCOMES = "case_id string, success boolean, skipped boolean, error string, total_volume_mm3 double"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows under ``path``; none before the first write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def outcomes(spark: SparkSession, tables: ArrivalTables) -> DataFrame:
    """The latest outcome of every case."""
    rows = _stored(spark, tables.outcomes, OUTCOMES + ", batch long")
    last = rows.groupBy("case_id").agg(F.max_by(F.struct("success", "skipped", "error", "total_volume_mm3"), "batch").alias("o"), F.max("batch").alias("batch"))
    return last.select("case_id", "o.*", "batch")


def segment_batch(spark: SparkSession, cases: DataFrame, number: int, tables: ArrivalTables, contents: Callable[[DataFrame], DataFrame], **segmentation) -> None:
    """Masks and outcomes of one batch of (case_id, ct_path, label_path, error).

    A batch that is repeated replaces its own rows: what counts as already segmented is only what earlier batches stored.
    Cases whose files cannot be read or differ in size fail alone.
    """
    staged = f"{tables.outcomes.rstrip('/')}-cases/batch={number}"
    # The stateful step runs once; all that follows reads its rows from here.
    cases.write.mode("overwrite").parquet(staged)
    cases = spark.read.schema(CASE_FILES).parquet(staged)
    ready = cases.where("error is null")
    target = f"{tables.outcomes.rstrip('/')}/batch={number}"
    if ready.isEmpty():
        rows = cases.select("case_id", F.lit(False).alias("success"), F.lit(False).alias("skipped"), "error", F.lit(None).cast("double").alias("total_volume_mm3"))
        rows.write.mode("overwrite").parquet(target)
        return
    files = ready.select("case_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_path").alias("path")) for k in ("ct", "label")))))
    # Files are decoded once; outcomes, sizes and voxels come from the stored slices. Case and kind are joined to files, not to slices.
    decoded = written(volumes.decode_files(looked_up(contents(files.select("path")), files, ["path"]), ["case_id", "kind"]), "decoded")
    cts, labels = decoded.where("kind = 'ct'"), decoded.where("kind = 'label'")
    unread = decoded.where("error is not null").groupBy("case_id").agg(F.min("error").alias("error"))
    # Masks need the cells of the CT only; of the label file, its size.
    voxels, table = volumes.slice_voxels(cts, "hu"), written(volumes.matched_cases(cts, labels), "cases")
    earlier = _stored(spark, tables.outcomes, OUTCOMES + ", batch long").where((F.col("batch") < number) & F.col("success")).select("case_id").distinct()
    kinds = F.explode(F.array(*(F.lit(k) for k in ("lung_mask", "upper_lung", "lower_lung"))))
    run = generate_masks(voxels, table, earlier.select("case_id", kinds.alias("mask_type")), **segmentation)
    write_masks(run.masks, tables.masks)
    # Every case of the batch has a row: segmented, failed, unreadable, unmatched or timed out.
    known = cases.select("case_id", F.col("error").alias("late")).join(unread, "case_id", "left").join(run.outcomes.withColumnRenamed("error", "problem"), "case_id", "left")
    error = F.coalesce("late", "error", "problem", F.when(F.col("success").isNull(), "CT and label file differ in size"))
    rows = known.select(
        "case_id", error.isNull().alias("success"), F.coalesce("skipped", F.lit(False)).alias("skipped"), error.alias("error"), F.when(error.isNull(), F.col("total_volume_mm3")).alias("total_volume_mm3"))
    rows.write.mode("overwrite").parquet(target)


def files_of(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Contents of volume files by path; a batch has as many paths as the stream admits files."""

    def read(paths: DataFrame) -> DataFrame:
        names = [r.path for r in paths.distinct().collect()]
        if not names:
            return spark.createDataFrame([], "path string, content binary")
        return spark.read.format("binaryFile").load(names).select("path", "content")

    return read


def segment_arrivals(
    files: DataFrame, checkpoint: str, tables: ArrivalTables, wait_seconds: int, contents: Callable[[DataFrame], DataFrame] | None = None,
    delay: str = "0 seconds", **segmentation,
) -> StreamingQuery:
    """Segment and store every case of the stream ``files`` (see ``arriving_files``) as it becomes complete."""
    spark = files.sparkSession
    read = contents or files_of(spark)
    return (
        paired_cases(files, wait_seconds, delay)
        .writeStream.foreachBatch(lambda batch, number: segment_batch(batch.sparkSession, batch, number, tables, read, **segmentation))
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
