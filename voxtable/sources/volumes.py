"""Ingest of compressed volume files into slice and voxel tables.

The files are gzip-compressed images with a 348-byte header. Spark lists and
spreads them; a small decoder turns one file into its slices. A volume is one
file, so it is the unit of reading; its slices leave the task one at a time.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxtable.functions.joins import shuffled
from voxtable.functions.names import file_name
from voxtable.sources.catalog import MASK_TYPES

# Numeric type codes of the header.
_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}

#: Cells that a batch of slices holds at most, if it is more than one slice.
BATCH_CELLS = 1 << 18

_SLICES = T.StructType(
    [T.StructField("path", T.StringType())]
    + [T.StructField(name, T.IntegerType()) for name in ("z", "nz", "ny", "nx")]
    + [T.StructField(name, T.DoubleType()) for name in ("sz", "sy", "sx")]
    + [T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())]
)


def _plain(content: bytes) -> bytes:
    # All members of a file with several.
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _header(raw: bytes) -> tuple[str, tuple[int, int, int], tuple[float, float, float]]:
    """Byte order, (z, y, x) size and (z, y, x) spacing, from the first 348 bytes of a volume file."""
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
    if struct.unpack_from(f"{order}i", raw, 0)[0] != 348:
        raise ValueError("the file has no volume header")
    shape = struct.unpack_from(f"{order}8h", raw, 40)
    spacing = struct.unpack_from(f"{order}8f", raw, 76)
    nx, ny, nz = (shape[n] if shape[0] >= n else 1 for n in (1, 2, 3))
    frames = int(np.prod([shape[n] for n in range(4, min(shape[0], 7) + 1)], dtype=np.int64))
    if frames != 1:
        raise ValueError(f"the file holds {frames} volumes")
    # The first axis of the file is x; in memory z comes first.
    return order, (nz, ny, nx), (spacing[3], spacing[2], spacing[1])


class Layout(NamedTuple):
    """How the cells of a volume file lie: (z, y, x) size and spacing, stored type, offset of the first cell, and scale."""

    shape: tuple[int, int, int]
    spacing: tuple[float, float, float]
    kind: np.dtype
    start: int
    slope: float
    intercept: float


def layout(raw: bytes) -> Layout:
    """From the first 348 bytes of a volume file."""
    order, shape, spacing = _header(raw)
    code = struct.unpack_from(f"{order}h", raw, 70)[0]
    start, slope, intercept = struct.unpack_from(f"{order}3f", raw, 108)
    return Layout(shape, spacing, np.dtype(order + _TYPES[code]), int(start), slope, intercept)


def whole_numbers(cells: np.ndarray, slope: float, intercept: float) -> np.ndarray:
    """Scaled cells, which must be whole 32-bit numbers."""
    if slope not in (0.0, 1.0) or intercept != 0.0:
        cells = cells * (slope or 1.0) + intercept
    if cells.dtype.kind == "f" or cells.dtype.itemsize > 2:
        whole = np.rint(cells.astype(np.float64))
        # A scale stored in single precision leaves a little dust on whole numbers.
        if not np.isfinite(whole).all() or np.abs(whole).max(initial=0.0) >= 1 << 31 or np.abs(cells - whole).max(initial=0.0) > 1e-3:
            raise ValueError("the volume holds values that are not whole 32-bit numbers")
        cells = whole
    return cells


def _decode(content: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Whole-number (z, y, x) array and (z, y, x) spacing of a volume file."""
    raw = _plain(content)
    form = layout(raw)
    cells = np.frombuffer(raw, dtype=form.kind, count=int(np.prod(form.shape, dtype=np.int64)), offset=form.start)
    return whole_numbers(cells, form.slope, form.intercept).reshape(form.shape), form.spacing


def decode_files(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per slice of (``path``, ``content``) rows; an unreadable file gives one row with ``error``.

    Columns in ``keep`` stay on every slice, so that slices need not be joined with what is known of their file.
    """
    keep = list(keep)
    out = T.StructType(_SLICES.fields + [files.schema[c] for c in keep])
    schema = to_arrow_schema(out)

    def decode(batches):
        for batch in batches:
            known = [dict(zip(keep, row)) for row in zip(*(batch.column(c).to_pylist() for c in keep))] if keep else [{}] * batch.num_rows
            for path, content, more in zip(batch.column("path").to_pylist(), batch.column("content"), known):
                try:
                    cells, (sz, sy, sx) = _decode(content.as_py())
                except Exception as problem:  # one bad file must not stop the others
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": repr(problem), **more}], schema=schema)
                    continue
                nz, ny, nx = cells.shape
                # Small slices travel together.
                some = max(1, BATCH_CELLS // max(1, ny * nx))
                for first in range(0, nz, some):
                    yield pa.RecordBatch.from_pylist([{
                        "path": path, "z": z, "nz": nz, "ny": ny, "nx": nx, "sz": sz, "sy": sy, "sx": sx,
                        "cells": cells[z].ravel().astype(np.int32), "error": None, **more,
                    } for z in range(first, min(first + some, nz))], schema=schema)

    return files.select("path", "content", *keep).mapInArrow(decode, out).withColumn("name", file_name(F.col("path")))


def decode_headers(files: DataFrame) -> DataFrame:
    """name, path, ``shape`` (text), ``spacing`` (z, y, x) and ``error`` of (``path``, ``content``) rows; no pixel is unpacked."""
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("shape", T.StringType()), T.StructField("spacing", T.ArrayType(T.DoubleType())),
        T.StructField("error", T.StringType()),
    ])

    def decode(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    raw = content.as_py()
                    raw = zlib.decompressobj(wbits=31).decompress(raw, 348) if raw[:2] == b"\x1f\x8b" else raw
                    _, shape, spacing = _header(raw)
                    rows.append({"path": path, "shape": "x".join(map(str, shape)), "spacing": spacing, "error": None})
                except Exception as problem:  # one bad file must not stop the others
                    rows.append({"path": path, "shape": None, "spacing": None, "error": repr(problem)})
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    return files.select("path", "content").mapInArrow(decode, schema).withColumn("name", file_name(F.col("path")))


def read_headers(spark: SparkSession, folder: str, pattern: str = "*.nii.gz") -> DataFrame:
    """Headers of the volume files of a folder, ready for ``catalog.ct_files`` and ``catalog.validated_cases``."""
    return decode_headers(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder))


def read_slices(spark: SparkSession, folder: str, pattern: str = "*.nii.gz") -> DataFrame:
    """Slices of the volume files of a folder."""
    return decode_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder))


def slice_voxels(slices: DataFrame, value: str, sparse: bool = False) -> DataFrame:
    """Voxel rows of slices; ``sparse`` leaves out zeros."""
    rows = slices.where(F.col("error").isNull()).select("case_id", "z", "nx", F.posexplode("cells").alias("at", value))
    if sparse:
        rows = rows.where(F.col(value) != 0)
    return rows.select(
        "case_id", "z", F.floor(F.col("at") / F.col("nx")).cast("int").alias("y"), F.pmod("at", "nx").alias("x"), value
    )


def case_table(slices: DataFrame) -> DataFrame:
    """Spacing and size per case."""
    sizes = ["sz", "sy", "sx", "nz", "ny", "nx"]
    return slices.where(F.col("error").isNull()).groupBy("case_id").agg(*[F.first(c).alias(c) for c in sizes])


def matched_cases(cts: DataFrame, lesions: DataFrame) -> DataFrame:
    """Case table of the cases whose two volumes have the same size.

    A volume that can be read gives all its slices, so the first slice of each tells, and no cells are read.
    """
    heads = [s.where(F.col("error").isNull() & (F.col("z") == 0)) for s in (cts, lesions)]
    key = ["case_id", "nz", "ny", "nx"]
    return case_table(heads[0].join(shuffled(heads[1].select(*key)), key, "left_semi"))


def load_cases(cts: DataFrame, lesions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense voxels (``hu``, ``lesion``) and case table of the cases whose two volumes match.

    Both inputs are slices with ``case_id``. They are zipped as slices, before any voxel row exists.
    """
    size = ["nz", "ny", "nx"]
    good = [s.where(F.col("error").isNull()) for s in (cts, lesions)]
    pairs = good[0].join(
        shuffled(good[1].select("case_id", "z", *size, F.col("cells").alias("labels"))), ["case_id", "z", *size]
    )
    voxels = pairs.select("case_id", "z", "nx", F.posexplode(F.arrays_zip("cells", "labels")).alias("at", "v")).select(
        "case_id", "z", F.floor(F.col("at") / F.col("nx")).cast("int").alias("y"), F.pmod("at", "nx").alias("x"),
        F.col("v.cells").alias("hu"), F.col("v.labels").alias("lesion"),
    )
    return voxels, case_table(pairs)


def load_masks(slices: DataFrame) -> DataFrame:
    """Mask voxels (case_id, mask_type, z, y, x) from slices of mask files; absent types have no rows."""
    pattern = rf"^CT_(.+)_({'|'.join(MASK_TYPES)})\.nii\.gz$"
    typed = slices.where(F.col("error").isNull() & F.col("name").rlike(pattern)).select(
        F.regexp_extract("name", pattern, 1).alias("case_id"), F.regexp_extract("name", pattern, 2).alias("mask_type"),
        "z", "nx", F.posexplode("cells").alias("at", "value"),
    )
    return typed.where(F.col("value") != 0).select(
        "case_id", "mask_type", "z", F.floor(F.col("at") / F.col("nx")).cast("int").alias("y"), F.pmod("at", "nx").alias("x")
    )


def with_masks(voxels: DataFrame, masks: DataFrame) -> DataFrame:
    """Dense voxels with 0/1 columns ``lung``, ``upper``, ``lower`` and ``lobe``; cases without masks get zeros."""
    key = ["case_id", "z", "y", "x"]
    sides = {"lung": "lung_mask", "upper": "upper_lung", "lower": "lower_lung", "lobe": "lobe_mask"}
    flags = masks.groupBy(*key).agg(
        *[F.max(F.when(F.col("mask_type") == kind, 1).otherwise(0)).alias(name) for name, kind in sides.items()]
    )
    return voxels.join(shuffled(flags), key, "left").fillna(0, list(sides))
