"""Exact Euclidean distance of foreground cells to the nearest background cell.

The squared distance separates by axis: one pass per axis, each a grouping of
whole lines. Lines travel in tiles (``tile`` cells along every other axis), so a
task holds ``tile² × line length`` cells whatever the size of the case.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxtable.functions.joins import looked_up

# A packed cell: line number, then 8 bits of carried label, then 32 bits of position.
_POSITION = 1 << 32
_LABEL = 1 << 8


# Cells of lines that are swept together; a larger group is swept alone.
_CELLS = 1 << 21


def _first_pass(inside: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Squared distance along the last axis to the nearest outside cell of the same line; a step per line group."""
    position = np.arange(inside.shape[-1], dtype=np.float64)
    before = np.maximum.accumulate(np.where(inside, -np.inf, position), axis=-1)
    after = np.minimum.accumulate(np.where(inside, np.inf, position)[..., ::-1], axis=-1)[..., ::-1]
    return (np.minimum(position - before, after - position) * step[:, None, None]) ** 2


def _next_pass(squared: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Lower envelope along axis 1: min over k of ``squared[k] + (step·(i-k))²``; a step per group on axis 0."""
    out = squared.copy()
    step = step[:, None, None]
    for shift in range(1, out.shape[1]):
        cost = (step * shift) ** 2
        # A farther cell cannot improve anything once its cost reaches the largest value.
        if (cost[:, 0, 0] >= out.max(axis=(1, 2), initial=0.0)).all():
            break
        np.minimum(out[:, shift:], squared[:, :-shift] + cost, out=out[:, shift:])
        np.minimum(out[:, :-shift], squared[:, shift:] + cost, out=out[:, :-shift])
    return out


def _alike(cells: int, *kinds: np.ndarray) -> list[np.ndarray]:
    """Rows with equal first kind (their length), ordered by the others, so that groups sweep with near steps; ``cells`` a row and unit length."""
    order, out, first = np.lexsort(kinds[::-1]), [], 0
    lengths = kinds[0][order]
    while first < len(order):
        last = first + max(_CELLS // (int(lengths[first]) * cells), 1)
        last = min(last, int(np.searchsorted(lengths, lengths[first], "right")))
        out.append(order[first:last])
        first = last
    return out


def _positions(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``rows`` and index of every element of the lists of these rows."""
    counts = ends[rows + 1] - ends[rows]
    own = np.repeat(np.arange(len(rows)), counts)
    return own, np.arange(len(own)) + np.repeat(ends[rows] - np.cumsum(counts) + counts, counts)


def _blocks(column, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Packed tiles of one size as one array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    if (np.diff(offsets) != size).any():
        raise ValueError("a tile of another size")
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data.view(kind).reshape((len(column), *shape))


def _packed(blocks: np.ndarray) -> pa.Array:
    """Each block of the first axis as one binary value."""
    data = np.ascontiguousarray(blocks).reshape(len(blocks), -1).view(np.uint8)
    offsets = np.arange(len(blocks) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(offsets), pa.py_buffer(data.ravel())])


def distance_map(
    foreground: DataFrame,
    geometry: DataFrame,
    keys: Sequence[str] = ("case_id",),
    axes: Sequence[str] = ("z", "y", "x"),
    geometry_key: str = "case_id",
    tile: int = 16,
    carry: str | None = None,
    out: str = "dist_mm",
) -> DataFrame:
    """One row per foreground cell with its distance; null where a volume has no background.

    ``geometry`` holds ``step_<axis>`` (mm) and ``len_<axis>`` (cells) per ``geometry_key``;
    cells outside the volume are not background. ``carry`` names a label column (0..255)
    that travels with the cells, so no join back to the voxels is needed. A label or a cell
    out of range raises an error, but only for volumes that ``geometry`` lists.
    """
    keys, axes = list(keys), list(axes)
    last, others = axes[-1], axes[:-1]
    attributes = [f"{kind}_{axis}" for kind in ("step", "len") for axis in axes]
    tiles = [f"{axis}_tile" for axis in axes]
    k = len(axes)

    line = F.lit(0).cast("bigint")
    for axis in others:
        line = line * tile + F.pmod(F.col(axis), F.lit(tile))
    label = F.lit(0) if carry is None else F.col(carry).cast("bigint")
    strips = (
        foreground.groupBy(
            *keys, *[F.floor(F.col(axis) / tile).cast("int").alias(f"{axis}_tile") for axis in others]
        )
        .agg(F.collect_list((line * _LABEL + label) * _POSITION + F.col(last)).alias("lines"),
             F.min(label).alias("label_low"), F.max(label).alias("label_high"), F.min(last).alias("at_low"), F.max(last).alias("at_high"))
    )
    strips = looked_up(strips, geometry.select(geometry_key, *attributes), [geometry_key])

    field = {f.name: f.dataType.simpleString() for f in strips.schema.fields}
    key_ddl = ", ".join(f"{name} {field[name]}" for name in keys)
    tile_ddl = ", ".join(
        [key_ddl]
        + [f"step_{axis} double" for axis in axes]
        + [f"len_{axis} int" for axis in axes]
        + [f"{name} int" for name in tiles]
        + ["cells binary", "labels binary"]
    )
    voxel_ddl = ", ".join([key_ddl] + [f"{axis} int" for axis in axes] + ["squared double", "label int"])
    tile_schema = to_arrow_schema(StructType.fromDDL(tile_ddl))
    voxel_schema = to_arrow_schema(StructType.fromDDL(voxel_ddl))

    def rasterise(batches):
        for batch in batches:
            lines = batch.column("lines")
            flat, ends = lines.values.to_numpy(), lines.offsets.to_numpy()
            length = batch.column(f"len_{last}").to_numpy()
            step = batch.column(f"step_{last}").to_numpy(zero_copy_only=False).astype(np.float64)
            for row in batch.select(["label_low", "label_high", "at_low", "at_high", f"len_{last}"]).filter(_misfit(batch)).to_pylist():
                if row["label_low"] is None or not 0 <= row["label_low"] <= row["label_high"] < _LABEL:
                    raise ValueError(f"labels {row['label_low']} to {row['label_high']} do not fit 0 to {_LABEL - 1}")
                raise ValueError(f"cells at {row['at_low']} to {row['at_high']} do not fit a line of {row[f'len_{last}']}")
            for rows in _alike(tile ** (k - 1), length, step):
                long = int(length[rows[0]])
                count = -(-long // tile)
                own, index = _positions(ends, rows)
                cells = flat[index]
                at = own, cells // (_POSITION * _LABEL), cells % _POSITION
                inside = np.zeros((len(rows), tile ** (k - 1), long), dtype=bool)
                labels = np.zeros((len(rows), tile ** (k - 1), count * tile), dtype=np.uint8)
                inside[at] = True
                labels[at] = cells // _POSITION % _LABEL
                squared = np.zeros((len(rows), tile ** (k - 1), count * tile))
                squared[..., :long] = np.where(inside, _first_pass(inside, step[rows]), 0.0)
                # Tiles first, then lines and cells of a tile; tiles without foreground end here.
                blocks, marks = (np.moveaxis(a.reshape(len(rows), -1, count, tile), 2, 1) for a in (squared, labels))
                group, number = np.nonzero(blocks.any(axis=(2, 3)))
                columns = {name: batch.column(name).take(pa.array(rows[group])) for name in keys + attributes + tiles[:-1]}
                columns[tiles[-1]] = pa.array(number.astype(np.int32))
                columns.update(cells=_packed(blocks[group, number]), labels=_packed(marks[group, number]))
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in tile_schema], schema=tile_schema)

    def _misfit(batch):
        low, high, first, end, length = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in ("label_low", "label_high", "at_low", "at_high", f"len_{last}"))
        return pa.array(~((0 <= low) & (low <= high) & (high < _LABEL) & (0 <= first) & (first <= end) & (end < length)))

    def sweep(axis_number: int, final: bool):
        axis = axes[axis_number]
        held = [name for number, name in enumerate(tiles) if number != axis_number]

        def run(batches):
            for batch in batches:
                parts = batch.column("parts")
                ends, inner = parts.offsets.to_numpy(), parts.values
                numbers, payload, marks = (inner.field(n) for n in range(3))
                numbers = numbers.to_numpy()
                length = batch.column(f"len_{axis}").to_numpy()
                step = batch.column(f"step_{axis}").to_numpy(zero_copy_only=False).astype(np.float64)
                for rows in _alike(tile ** (k - 1), length, step):
                    long = int(length[rows[0]])
                    own, index = _positions(ends, rows)
                    number = numbers[index]
                    if len(number) and not 0 <= number.min() <= number.max() < -(-long // tile):
                        raise ValueError(f"cells along {axis} do not fit a length of {long}")
                    # The swept axis comes first in a block while it is swept.
                    blocks = np.moveaxis(_blocks(payload.take(pa.array(index)), (tile,) * k, np.float64), axis_number + 1, 1)
                    dense = np.zeros((len(rows), -(-long // tile), tile, tile ** (k - 1)))
                    dense[own, number] = blocks.reshape(len(index), tile, -1)
                    dense = dense.reshape(len(rows), -1, tile ** (k - 1))
                    dense[:, :long] = _next_pass(dense[:, :long], step[rows])
                    swept = dense.reshape(len(rows), -1, tile, tile ** (k - 1))[own, number].reshape(blocks.shape)
                    blocks = np.moveaxis(swept, 1, axis_number + 1)
                    labels = marks.take(pa.array(index))
                    if not final:
                        columns = {name: batch.column(name).take(pa.array(rows[own])) for name in keys + attributes + held}
                        columns.update({tiles[axis_number]: pa.array(number), "cells": _packed(blocks), "labels": labels})
                        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in tile_schema], schema=tile_schema)
                        continue
                    found = np.nonzero(blocks)
                    block, row = found[0], pa.array(rows[own][found[0]])
                    columns = {name: batch.column(name).take(row) for name in keys}
                    for n, name in enumerate(axes):
                        base = number if n == axis_number else batch.column(tiles[n]).to_numpy()[rows[own]]
                        columns[name] = pa.array(base[block].astype(np.int64) * tile + found[n + 1])
                    columns["squared"] = pa.array(blocks[found])
                    columns["label"] = pa.array(_blocks(labels, (tile,) * k, np.uint8)[found].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in voxel_schema], schema=voxel_schema)

        return run

    tiled = strips.mapInArrow(rasterise, tile_ddl)
    for axis_number in range(k - 2, -1, -1):
        moved = tiles[axis_number]
        group = keys + [name for name in tiles if name != moved]
        # The steps and lengths of a group are those of its case.
        stacks = tiled.groupBy(*group).agg(
            *[F.first(name).alias(name) for name in attributes],
            F.collect_list(F.struct(moved, "cells", "labels")).alias("parts"),
        )
        final = axis_number == 0
        tiled = stacks.mapInArrow(sweep(axis_number, final), voxel_ddl if final else tile_ddl)
    dist = F.when(F.col("squared") == float("inf"), F.lit(None)).otherwise(F.sqrt("squared"))
    carried = [] if carry is None else [F.col("label").alias(carry)]
    return tiled.select(*keys, *axes, *carried, dist.alias(out))


def volume_geometry(cases: DataFrame) -> DataFrame:
    """``step_*`` and ``len_*`` of the three axes from the case table."""
    return cases.select(
        "case_id",
        *[F.col(f"s{axis}").alias(f"step_{axis}") for axis in "zyx"],
        *[F.col(f"n{axis}").cast("int").alias(f"len_{axis}") for axis in "zyx"],
    )


def lung_depth(voxels: DataFrame, cases: DataFrame, tile: int = 16) -> DataFrame:
    """Distance of every lung voxel to the nearest voxel outside the lung, in mm."""
    lung = voxels.where(F.col("lung") > 0).select("case_id", "z", "y", "x")
    return distance_map(lung, volume_geometry(cases), tile=tile)


def voxel_features(voxels: DataFrame, cases: DataFrame, tile: int = 16) -> DataFrame:
    """Lung voxels with lesion label and depth: the one table all depth measures read."""
    lung = voxels.where(F.col("lung") > 0).select("case_id", "z", "y", "x", "lesion")
    return distance_map(lung, volume_geometry(cases), tile=tile, carry="lesion")
