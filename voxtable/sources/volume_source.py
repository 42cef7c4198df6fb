"""Volume files as a Spark data source, ``spark.read.format("volumes")`` and ``df.write.format("volumes")``.

Reading plans tasks from the folder's listing: small files are bundled, an uncompressed file larger than ``slabBytes`` is cut into slabs of
slices that are read by themselves. A task reads the 348 bytes of a header and then only the slices that are wanted: filters on
``case_id``, ``kind`` and ``z`` reach the files. With ``headersOnly`` no cell is read. Compressed files are unpacked as a stream, slice by slice.

Writing takes slices, in order of name and z within a task, and writes one file per name to a staging folder. The commit moves the files of the
tasks that succeeded into place and stores one row per file beside them, so attempts that failed leave nothing behind.

Files are reached by ``pyarrow.fs``, which knows local and mounted folders and the usual object stores by their addresses.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import json
import math
import re
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from voxtable.functions.joins import looked_up
from voxtable.sources.catalog import MASK_TYPES
from voxtable.sources.volumes import Layout, layout, whole_numbers

HEADER = 348
#: Offset of the first cell in the files written.
FIRST_CELL = 352
CHUNK = 1 << 20
#: Tasks that the slabs of a folder make at most, tasks that its small files are spread over, and what opening a file costs, in bytes.
SHARES, FEW_SHARES, OPENING = 1024, 256, 1 << 16
SLICES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("path", "name", "case_id", "kind")]
    + [T.StructField(n, T.IntegerType()) for n in ("z", "nz", "ny", "nx")]
    + [T.StructField(n, T.DoubleType()) for n in ("sz", "sy", "sx")]
    + [T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())]
)
OUTCOMES = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()),
    T.StructField("voxels", T.LongType()), T.StructField("changed", T.LongType()),
    T.StructField("before", T.MapType(T.StringType(), T.LongType())), T.StructField("after", T.MapType(T.StringType(), T.LongType())),
])


def case_and_kind(name: str) -> tuple[str | None, str | None]:
    """The case of a file name, and whether it is a CT, a label or which mask file."""
    found = re.fullmatch(rf"CT_(.+?)(?:_(0000|{'|'.join(MASK_TYPES)}))?\.nii(?:\.gz)?", name)
    if not found:
        return None, None
    return found[1], {"0000": "ct", None: "label"}.get(found[2], found[2])


class _Source:
    """One file, read from its start or at places, with the bytes read so far."""

    def __init__(self, path: str) -> None:
        system, place = fs.FileSystem.from_uri(path)
        self.file, self.packed, self.read = system.open_input_file(place), path.endswith(".gz"), 0

    def header(self) -> bytes:
        return self._unpacked_head() if self.packed else self.at(0, HEADER)

    def at(self, place: int, size: int) -> bytes:
        self.read += size
        return self.file.read_at(size, place)

    def _unpacked_head(self) -> bytes:
        unpack, out, place = zlib.decompressobj(wbits=31), b"", 0
        while len(out) < HEADER and (chunk := self.at(place, 512)):
            place += len(chunk)
            out += unpack.decompress(chunk)
        return out[:HEADER]

    def slices(self, form: Layout, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        """Slices low to high - 1, one at a time."""
        nz, ny, nx = form.shape
        size = ny * nx * form.kind.itemsize
        if not self.packed:
            for z in range(low, high):
                yield z, np.frombuffer(self.at(form.start + z * size, size), form.kind)
            return
        # A compressed file has one way through; slices before the first wanted one are unpacked and let go.
        self.file.seek(0)
        with gzip.GzipFile(fileobj=self.file) as stream:
            stream.read(form.start)
            for z in range(high):
                raw = stream.read(size)
                if len(raw) < size:
                    raise EOFError(f"the file ends in slice {z} of {nz}")
                if z >= low:
                    yield z, np.frombuffer(raw, form.kind)


@dataclass
class Share(InputPartition):
    """Part ``part`` of ``parts`` of each of some files."""

    files: list[tuple[str, int, int]]
    value: int = 0


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.pattern = options["path"], options.get("pattern", "*.nii*")
        self.slab, self.bundle = int(options.get("slabbytes", 64 << 20)), int(options.get("bundlebytes", 64 << 20))
        self.headers = options.get("headersonly", "false").lower() == "true"
        self.cases: set | None = None
        self.kinds: set | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on case_id, kind and z; the rest is left to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in ("case_id", "kind") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = "cases" if column == "case_id" else "kinds"
                known = getattr(self, name)
                setattr(self, name, values if known is None else known & values)
            elif column == "z" and not self.headers and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
                yield f  # rows of unreadable files have no z; Spark drops them
            else:
                yield f

    def partitions(self) -> list[Share]:
        system, place = fs.FileSystem.from_uri(self.folder)
        prefix = self.folder[: len(self.folder) - len(place)] if self.folder.endswith(place) else ""
        slabs: list[tuple[str, int, int]] = []
        small: list[tuple[str, int, int, int]] = []
        for info in sorted(system.get_file_info(fs.FileSelector(place)), key=lambda i: i.path):
            case, kind = case_and_kind(info.base_name)
            if info.type != fs.FileType.File or not fnmatch.fnmatch(info.base_name, self.pattern):
                continue
            if (self.cases is not None and case not in self.cases) or (self.kinds is not None and kind not in self.kinds):
                continue
            parts = 1 if self.headers or info.path.endswith(".gz") else max(1, math.ceil(info.size / self.slab))
            if parts > 1:
                slabs += [(prefix + info.path, k, parts) for k in range(parts)]
                continue
            small.append((prefix + info.path, 0, 1, OPENING + (HEADER if self.headers else info.size)))
        # Slabs lie by themselves as long as they are not many.
        together = max(1, math.ceil(len(slabs) / SHARES))
        out = [Share(slabs[k:k + together]) for k in range(0, len(slabs), together)]
        limit = min(self.bundle, max(CHUNK, math.ceil(sum(f[3] for f in small) / FEW_SHARES)))
        bundle, size = [], 0
        for *file, cost in small:
            bundle.append(tuple(file))
            size += cost
            if size >= limit:
                out.append(Share(bundle))
                bundle, size = [], 0
        return out + ([Share(bundle)] if bundle else []) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(SLICES)
        for path, part, parts in partition.files:
            name = path.rsplit("/", 1)[-1]
            case, kind = case_and_kind(name)
            row = {"path": path, "name": name, "case_id": case, "kind": kind}
            try:
                source = _Source(path)
                form = layout(source.header())
                (nz, ny, nx), (sz, sy, sx) = form.shape, form.spacing
                row |= {"nz": nz, "ny": ny, "nx": nx, "sz": sz, "sy": sy, "sx": sx}
                if self.headers:
                    yield pa.RecordBatch.from_pylist([row], schema=schema)
                    continue
                low, high = max(self.low, nz * part // parts), nz * (part + 1) // parts
                high = high if self.high is None else min(high, self.high)
                rows, held, fault = [], 0, None
                try:
                    for z, cells in source.slices(form, low, high):
                        rows.append(row | {"z": z, "cells": whole_numbers(cells, form.slope, form.intercept).astype(np.int32)})
                        held += rows[-1]["cells"].nbytes
                        if held >= CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                except Exception as problem:  # slices before a fault are rows too
                    fault = problem
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                if fault is not None:
                    raise fault
            except Exception as problem:  # one bad file must not stop the others
                if part == 0:
                    yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("path", "name", "case_id", "kind")} | {"error": repr(problem)}], schema=schema)


def header_bytes(shape: tuple[int, int, int], spacing: tuple[float, float, float]) -> bytes:
    """Header of a file of 16-bit cells for a (z, y, x) size and spacing."""
    header = bytearray(FIRST_CELL)
    struct.pack_into("<i", header, 0, HEADER)
    struct.pack_into("<8h", header, 40, 3, *reversed(shape), 1, 1, 1, 1)
    struct.pack_into("<hh", header, 70, 4, 16)
    struct.pack_into("<8f", header, 76, 1.0, *reversed(spacing), 0, 0, 0, 0)
    struct.pack_into("<3f", header, 108, float(FIRST_CELL), 1.0, 0.0)
    header[344:348] = b"n+1\0"
    return bytes(header)


@dataclass
class Written(WriterCommitMessage):
    """Where a task has listed its staged files and their outcomes; the lists themselves do not pass through the driver at once."""

    listed: str
    outcomes: str

    def moves(self) -> Iterator[tuple[str, str]]:
        """(staged, name) of the whole files."""
        system, place = fs.FileSystem.from_uri(self.listed)
        with system.open_input_stream(place, compression=None) as raw, io.TextIOWrapper(raw, encoding="utf-8") as lines:
            yield from (tuple(json.loads(line)) for line in lines)

    @property
    def files(self) -> list[tuple[str, str]]:
        return list(self.moves())


class _File:
    """A staged file that grows slice by slice, and what is known about it."""

    def __init__(self, system: fs.FileSystem, folder: str, name: str, row: dict) -> None:
        self.name, self.staged = name, f"{folder}/{uuid.uuid4().hex}-{name}"
        self.shape, self.spacing = (row["nz"], row["ny"], row["nx"]), (row["sz"], row["sy"], row["sx"])
        self.before, self.after, self.changed, self.next, self.error = Counter(), Counter(), 0, 0, None
        raw = system.open_output_stream(self.staged, compression=None)
        self.raw, self.stream = raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1, mtime=0) if name.endswith(".gz") else raw
        self.stream.write(header_bytes(self.shape, self.spacing))

    def add(self, row: dict) -> None:
        cells = np.asarray(row["cells"], np.int64)
        if row["z"] != self.next or len(cells) != self.shape[1] * self.shape[2]:
            raise ValueError(f"slice {self.next} is missing or has another size")
        if len(cells) and (cells.min() < -(1 << 15) or cells.max() >= 1 << 15):
            raise ValueError("the volume holds values that are no 16-bit numbers")
        self.next += 1
        self.stream.write(cells.astype("<i2").tobytes())
        source = np.asarray(row.get("source") if row.get("source") is not None else cells, np.int64)
        self.changed += int((source != cells).sum())
        for counts, values in ((self.before, source), (self.after, cells)):
            counts.update(dict(zip(*(x.tolist() for x in np.unique(values, return_counts=True)))))

    def close(self) -> None:
        if self.stream is not self.raw:
            self.stream.close()
        self.raw.close()

    def outcome(self) -> dict:
        if self.error is None and self.next != self.shape[0]:
            self.error = f"{self.next} of {self.shape[0]} slices"
        good = self.error is None
        return {
            "name": self.name, "success": good, "error": self.error, "voxels": int(np.prod(self.shape)) if good else None, "changed": self.changed if good else None,
            "before": {str(k): v for k, v in self.before.items()} if good else None, "after": {str(k): v for k, v in self.after.items()} if good else None,
        }


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.target = options["path"].rstrip("/")
        self.staging = f"{self.target}/_staged-{uuid.uuid4().hex}"

    def _place(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self._place(self.staging)
        system.create_dir(folder, recursive=True)
        attempt, now = uuid.uuid4().hex, None
        out = Written(f"{self.staging}/{attempt}.files", f"{self.staging}/{attempt}.json")
        files, outcomes = (system.open_output_stream(f"{folder}/{attempt}.{kind}", compression=None) for kind in ("files", "json"))
        line = lambda to, value: to.write((json.dumps(value) + "\n").encode())

        def finish() -> None:
            if now is not None:
                now.close()
                outcome = now.outcome()
                line(outcomes, outcome)
                if outcome["success"]:
                    line(files, (now.staged, now.name))

        with files, outcomes:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row.get("error") is not None:
                        line(outcomes, {"name": row["name"], "success": False, "error": row["error"]})
                        continue
                    if now is None or now.name != row["name"]:
                        finish()
                        now = _File(system, folder, row["name"], row)
                    if now.error is None:
                        try:
                            now.add(row)
                        except Exception as problem:  # this file fails, the others go on
                            now.error = repr(problem)
            finish()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, target = self._place(self.target)
        _, folder = self._place(self.staging)
        self._clear(system, f"{target}/outcomes")
        system.create_dir(f"{target}/outcomes", recursive=True)
        for message in messages:
            if message is None:
                continue
            for staged, name in message.moves():
                system.move(staged, f"{target}/{name}")
            _, place = self._place(message.outcomes)
            system.move(place, f"{target}/outcomes/{place.rsplit('/', 1)[-1]}")
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = self._place(self.staging)
        self._clear(system, folder)

    @staticmethod
    def _clear(system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class VolumeSource(DataSource):
    """Options: path, pattern, headersOnly, slabBytes, bundleBytes."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> T.StructType:
        return SLICES

    def reader(self, schema: T.StructType) -> VolumeReader:
        return VolumeReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)


def read_volumes(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("volumes").options(**options).load(folder)


def volume_slices(voxels: DataFrame, cases: DataFrame, value: str) -> DataFrame:
    """Slices as arrays from dense voxels: case_id, z, sizes, spacing, cells."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).cast("int").alias("v")))), lambda s: s["v"])
    return looked_up(voxels.groupBy("case_id", "z").agg(cells.alias("cells")), cases.select("case_id", "nz", "ny", "nx", "sz", "sy", "sx"), ["case_id"])


def write_volumes(slices: DataFrame, folder: str) -> DataFrame:
    """One file per ``name`` from slices (name, z, nz, ny, nx, sz, sy, sx, cells, and ``source``: the cells before a change); its outcomes.

    Rows with an ``error`` become failures. A file is written by one task, a slice at a time; the task holds no more than one slice.
    """
    spark = slices.sparkSession
    register(spark)
    columns = ["name", "z", "nz", "ny", "nx", "sz", "sy", "sx", "cells", *(c for c in ("source", "error") if c in slices.columns)]
    ordered = slices.select(*columns).repartition("name").sortWithinPartitions("name", "z")
    ordered.write.format("volumes").mode("append").save(folder)
    return read_outcomes(spark, folder)


def read_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: name, success, error, voxels, changed, and voxels by label before and after."""
    return spark.read.schema(OUTCOMES).json(f"{folder.rstrip('/')}/outcomes")


def relabel_files(slices: DataFrame, folder: str, mapping: dict[int, int]) -> DataFrame:
    """Write every volume of ``slices`` with its labels mapped to a new folder; the source stays as it is. Returns the outcomes."""
    table = F.create_map(*(F.lit(v) for pair in mapping.items() for v in pair))
    moved = F.transform("cells", lambda c: F.coalesce(table[c], c))
    return write_volumes(slices.withColumn("source", F.col("cells")).withColumn("cells", moved), folder)


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("total_files"), F.count_if("success").alias("successful_files"), F.count_if(~F.col("success")).alias("failed_files"),
        F.coalesce(F.sum("changed"), F.lit(0)).alias("total_converted"),
    )
