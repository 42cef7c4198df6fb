"""Connected components of labelled cells, in bounded tiles and then across tiles.

Cells are grouped into tiles with one shared layer towards the next tile. Inside
a tile a small array kernel finds local components; cells seen by several tiles
give links between local components, and an edge-only fixpoint joins them. No
group ever exceeds one tile, and no key holds more rows than a tile.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxtable.functions.joins import shuffled
from voxtable.session import written

# Cells are numbered in scan order with 21 bits per axis.
_AXIS = 1 << 21
# Planes of a stacked key that share a group.
STACK = 16
# Places of a kernel's grid, and cells it labels at once: many small tiles share a call, a large one has its own.
_GRID = 1 << 22
_CELLS = 1 << 19


def cell_number(axes: Sequence[str]) -> Column:
    """Scan-order number of a cell; the smallest one names its component."""
    out = F.lit(0).cast("bigint")
    for axis in axes:
        fits = (F.col(axis) >= 0) & (F.col(axis) < _AXIS)
        out = out * _AXIS + F.when(fits | F.col(axis).isNull(), F.col(axis)).otherwise(F.raise_error(F.lit(f"{axis} needs 0 to {_AXIS - 1}")).cast("bigint"))
    return out


def _half_neighbours(dimensions: int, connectivity: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite neighbour offsets.

    ``connectivity`` is the largest number of axes a neighbour may differ in: 1 for
    faces (4 or 6 neighbours), ``dimensions`` for faces, edges and corners (8 or 26).
    """
    offsets = product((-1, 0, 1), repeat=dimensions)
    return [step for step in offsets if step > (0,) * dimensions and np.count_nonzero(step) <= connectivity]


def _merge(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable member of every member, given pairs of neighbours."""
    root = np.arange(count)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        # Pairs that meet stay together, so they are done.
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _local_roots(at: np.ndarray, grid: np.ndarray, steps: list[int]) -> np.ndarray:
    """Index of the first cell of each cell's component; ``at`` holds places in ``grid``, ascending, ``steps`` distances in it.

    ``grid`` is -1 everywhere before and after.
    """
    grid[at] = np.arange(len(at))
    left, right = [], []
    for step in steps:
        other = grid[at + step]
        found = np.nonzero(other >= 0)[0]
        left.append(found)
        right.append(other[found])
    grid[at] = -1
    return _merge(len(at), np.concatenate(left), np.concatenate(right))


def _runs_of_tiles(ends: np.ndarray, places: int) -> list[tuple[int, int]]:
    """First and last tile of runs with at most ``_GRID`` places and about ``_CELLS`` cells, one tile at least."""
    most, runs, first = max(_GRID // places, 1), [], 0
    while first < len(ends) - 1:
        last = int(np.searchsorted(ends, ends[first] + _CELLS, "right")) - 1
        last = min(max(last, first + 1), first + most, len(ends) - 1)
        runs.append((first, last))
        first = last
    return runs


def _tiled(cells: DataFrame, axes: Sequence[str], tile: int) -> DataFrame:
    """Each cell in its own tile and, from a tile's first layer, in the tiles before it."""
    out = cells
    for axis in axes:
        own = F.floor(F.col(axis) / tile).cast("int")
        first = (F.pmod(F.col(axis), F.lit(tile)) == 0) & (own > 0)
        out = out.withColumn(f"{axis}_tile", F.explode(F.when(first, F.array(own, own - 1)).otherwise(F.array(own))))
    return out


def local_components(
    cells: DataFrame, keys: Sequence[str], axes: Sequence[str], connectivity: int, tile: int, stacked: str | None = None
) -> DataFrame:
    """Rows (keys, axes, ``root``, ``home``): one per cell and tile that sees it.

    ``stacked`` names a whole-number key whose neighbouring values share a group: small
    planes then travel together, without being neighbours.
    """
    keys, axes = list(keys), list(axes)
    fixed = [name for name in keys if name != stacked]
    moving = axes if stacked is None else [stacked, *axes]
    steps = _half_neighbours(len(axes), connectivity)
    steps = steps if stacked is None else [(0, *step) for step in steps]
    size = [tile] * len(axes) if stacked is None else [STACK] + [tile] * len(axes)
    # A tile holds one layer of the next one; a margin on every side keeps neighbours inside its places.
    lengths = [length + 3 for length in size]
    strides = [int(np.prod(lengths[n + 1:], dtype=np.int64)) for n in range(len(lengths))]
    places = lengths[0] * strides[0]
    distances = [sum(move * stride for move, stride in zip(step, strides)) for step in steps]
    tiles = [f"{name}_tile" for name in moving]
    field = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    ddl = ", ".join([f"{n} {field[n]}" for n in keys] + [f"{a} int" for a in axes] + ["root bigint", "home boolean"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def label(batches):
        grid = np.full(max(_GRID, places), -1, dtype=np.int64)
        for batch in batches:
            bases = []
            for name, length in zip(tiles, size):
                if batch.column(name).null_count:
                    raise ValueError(f"cells without {name.removesuffix('_tile')}")
                bases.append(batch.column(name).to_numpy().astype(np.int64) * length)
            lists = batch.column("cells")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for first, last in _runs_of_tiles(ends, places):
                own = np.repeat(np.arange(last - first), np.diff(ends[first:last + 1]))
                at = np.sort(own * places + flat[ends[first]:ends[last]])
                own, rest = np.divmod(at, places)
                here, home = {}, np.ones(len(at), dtype=bool)
                number = np.zeros(len(at), dtype=np.int64)
                for name, base, length, stride in zip(moving, bases, size, strides):
                    offset, rest = np.divmod(rest, stride)
                    home &= offset <= length
                    here[name] = base[first + own] + offset - 1
                    if name != stacked:
                        number = number * _AXIS + here[name]
                columns = {name: batch.column(name).take(pa.array(first + own)) for name in fixed}
                columns.update(here, root=number[_local_roots(at, grid, distances)], home=home)
                arrays = [columns[f.name] if f.name in fixed else pa.array(columns[f.name]) for f in schema]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    tiled = _tiled(cells.select(*keys, *axes), axes, tile)
    if stacked is not None:
        tiled = tiled.withColumn(f"{stacked}_tile", F.floor(F.col(stacked) / STACK).cast("bigint"))
    place = F.lit(0).cast("bigint")
    for name, length, stride in zip(moving, size, strides):
        place = place + (F.col(name) - F.col(f"{name}_tile") * length + 1) * stride
    # Cells travel packed, and a call of the kernel takes as many tiles as a batch holds.
    packed = tiled.groupBy(*fixed, *tiles).agg(F.collect_list(place).alias("cells"))
    return packed.mapInArrow(label, ddl)


def _stars(links: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Turn links (``high``, ``low``) into stars: every member linked to its smallest member.

    Alternates large-star and small-star steps on the link table until it is stable.
    """
    def joined(pairs: DataFrame) -> DataFrame:
        smallest = pairs.groupBy(*keys, "node").agg(F.min(F.least("node", "other")).alias("low"))
        return pairs.join(shuffled(smallest), keys + ["node"])

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*keys, "high", "low").cast("decimal(38,0)"))).first())

    before = mark(links)
    while before[0]:
        both = links.select(*keys, F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
            links.select(*keys, F.col("low").alias("node"), F.col("high").alias("other"))
        )
        large = (
            joined(both)
            .where(F.col("other") > F.col("node"))
            .select(*keys, F.col("other").alias("high"), "low")
            .where(F.col("high") > F.col("low"))
            .distinct()
        )
        down = large.select(*keys, F.col("high").alias("node"), F.col("low").alias("other"))
        small = joined(down)
        links = written(
            small.select(*keys, F.col("other").alias("high"), "low")
            .unionByName(small.select(*keys, F.col("node").alias("high"), "low"))
            .where(F.col("high") > F.col("low"))
            .distinct(),
            name,
        )
        after = mark(links)
        if after == before:
            break
        before = after
    return links


def connect(
    cells: DataFrame, keys: Sequence[str], axes: Sequence[str], connectivity: int | None = None, tile: int | None = None,
    stacked: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Label cells with tile-local roots, and map every root to its component.

    Returns ``(labelled, roots)``: one row per cell with ``root``, and one row per
    (keys, root) with ``component``. Joins on ``root`` touch at most a few tiles per
    key, so one huge component never lands in one task.
    """
    keys, axes = list(keys), list(axes)
    connectivity = len(axes) if connectivity is None else connectivity
    tile = (32 if len(axes) > 2 else 128) if tile is None else tile
    local = written(local_components(cells, keys, axes, connectivity, tile, stacked), "components")
    shared = F.lit(False)
    for axis in axes:
        shared = shared | ((F.pmod(F.col(axis), F.lit(tile)) == 0) & (F.col(axis) > 0))
    links = (
        local.where(shared)
        .groupBy(*keys, *axes)
        .agg(F.min("root").alias("low"), F.collect_set("root").alias("seen"))
        .select(*keys, F.explode("seen").alias("high"), "low")
        .where(F.col("high") > F.col("low"))
        .distinct()
    )
    stars = _stars(written(links, "links"), keys, "links")
    labelled = local.where("home").drop("home")
    roots = (
        labelled.select(*keys, "root")
        .distinct()
        .join(shuffled(stars.withColumnRenamed("high", "root")), keys + ["root"], "left")
        .select(*keys, "root", F.coalesce("low", "root").alias("component"))
    )
    return labelled, roots


def label_components(
    cells: DataFrame, keys: Sequence[str], axes: Sequence[str], connectivity: int | None = None, tile: int | None = None
) -> DataFrame:
    """One row per cell with ``component``: the scan-order number of its first cell."""
    labelled, roots = connect(cells, keys, axes, connectivity, tile)
    return labelled.join(shuffled(roots), [*keys, "root"]).drop("root")


def component_stats(labelled: DataFrame, roots: DataFrame, keys: Sequence[str], axes: Sequence[str] = ()) -> DataFrame:
    """``size`` and ``min_<axis>``/``max_<axis>`` per component, reduced per root first."""
    keys = list(keys)
    bounds = [f"{kind}_{axis}" for axis in axes for kind in ("min", "max")]
    per_root = labelled.groupBy(*keys, "root").agg(
        F.count("*").alias("size"),
        *[getattr(F, kind)(axis).alias(f"{kind}_{axis}") for axis in axes for kind in ("min", "max")],
    )
    return (
        per_root.join(shuffled(roots), keys + ["root"])
        .groupBy(*keys, "component")
        .agg(F.sum("size").alias("size"), *[getattr(F, name[:3])(name).alias(name) for name in bounds])
    )


def keep_components(labelled: DataFrame, roots: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of the components listed in ``kept``."""
    keys = list(keys)
    kept_roots = roots.join(shuffled(kept.select(*keys, "component")), keys + ["component"], "left_semi")
    return labelled.join(shuffled(kept_roots.select(*keys, "root")), keys + ["root"], "left_semi").drop("root")


def dust(
    cells: DataFrame, keys: Sequence[str], axes: Sequence[str], min_size: int, tile: int | None = None, stacked: str | None = None
) -> DataFrame:
    """Drop fully connected components smaller than ``min_size`` cells."""
    labelled, roots = connect(cells, keys, axes, tile=tile, stacked=stacked)
    kept = component_stats(labelled, roots, keys).where(F.col("size") >= min_size)
    return keep_components(labelled, roots, kept, keys)


def clean_labels(voxels: DataFrame, min_voxels: int = 1000, min_pixels: int = 100) -> DataFrame:
    """Lesion voxels after dropping small same-label objects, in the volume and then per slice."""
    lesions = voxels.where(F.col("lesion") > 0).select("case_id", "lesion", "z", "y", "x")
    solid = dust(lesions, ["case_id", "lesion"], ["z", "y", "x"], min_voxels)
    return dust(solid, ["case_id", "lesion", "z"], ["y", "x"], min_pixels, stacked="z").select("case_id", "z", "y", "x", "lesion")
