"""Components against a flood fill, with tiles small enough to cut them."""

from itertools import product

import numpy as np
import pytest

from voxtable.operators.components import clean_labels, label_components


def flood(mask, connectivity):
    cells = set(map(tuple, np.argwhere(mask)))
    steps = [s for s in product((-1, 0, 1), repeat=mask.ndim) if any(s) and np.count_nonzero(s) <= connectivity]
    root = {}
    for start in sorted(cells):
        if start in root:
            continue
        root[start], stack = start, [start]
        while stack:
            here = stack.pop()
            for step in steps:
                there = tuple(a + b for a, b in zip(here, step))
                if there in cells and there not in root:
                    root[there] = start
                    stack.append(there)
    return root


def packed(cell):
    number = 0
    for value in cell:
        number = number * (1 << 21) + int(value)
    return number


@pytest.mark.parametrize("connectivity,density", [(3, 0.12), (1, 0.35)])
def test_components_across_tiles(spark, connectivity, density):
    rows, expected = [], {}
    for case in range(2):
        mask = np.random.default_rng(case).random((9, 10, 11)) < density
        for cell, root in flood(mask, connectivity).items():
            rows.append((case, *map(int, cell)))
            expected[(case, *map(int, cell))] = packed(root)
    cells = spark.createDataFrame(rows, "case_id bigint, z int, y int, x int")
    for tile in (4, 32):
        got = label_components(cells, ["case_id"], ["z", "y", "x"], connectivity, tile).collect()
        assert {(r.case_id, r.z, r.y, r.x): r.component for r in got} == expected


def test_one_long_component_over_many_tiles(spark):
    # A spiral: one component that enters and leaves most tiles.
    mask = np.zeros((17, 17), bool)
    for ring in range(0, 9, 2):
        mask[ring, ring:17 - ring] = mask[ring:17 - ring, 16 - ring] = True
        mask[16 - ring, ring:17 - ring] = True
        mask[ring + 2:17 - ring, ring] = True
        if ring + 2 < 17 - ring:
            mask[ring + 2, ring:ring + 3] = True
    rows = [(0, int(y), int(x)) for y, x in np.argwhere(mask)]
    cells = spark.createDataFrame(rows, "case_id bigint, y int, x int")
    got = label_components(cells, ["case_id"], ["y", "x"], tile=3).collect()
    assert {(r.y, r.x): r.component for r in got} == {k: packed(v) for k, v in flood(mask, 2).items()}


def test_dust_keeps_the_threshold_size(spark):
    rows = [(1, 0, 0, x, 2) for x in range(5)] + [(1, 0, 5, x, 2) for x in range(4)] + [(1, 0, 9, x, 3) for x in range(5)]
    voxels = spark.createDataFrame(rows, "case_id bigint, z int, y int, x int, lesion int")
    kept = clean_labels(voxels, 5, 5).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in kept} == {0: 5, 9: 5}


def test_small_tiles_share_a_kernel_call(spark):
    """No call per tile, and tiles of one call never touch: each has its own places of the grid."""
    import numpy as np

    from voxtable.operators import components

    rng = np.random.default_rng(21)
    masks = rng.random((6, 9, 11, 13)) < 0.3
    rows = [(int(c), int(z), int(y), int(x)) for c, z, y, x in np.argwhere(masks)]
    cells = spark.createDataFrame(rows, "case_id long, z int, y int, x int")
    local = components.local_components(cells, ["case_id"], ["z", "y", "x"], 3, 4)
    plan = local._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    got = {(r.case_id, r.z, r.y, r.x): r.component for r in components.label_components(cells, ["case_id"], ["z", "y", "x"], tile=4).collect()}
    left, want = set(rows), {}
    for cell in sorted(rows):
        if cell in left:
            name, open_cells = (cell[1] * (1 << 21) + cell[2]) * (1 << 21) + cell[3], [cell]
            left.discard(cell)
            while open_cells:
                c, z, y, x = open_cells.pop()
                want[c, z, y, x] = name
                near = {(c, z + dz, y + dy, x + dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
                left -= near
                open_cells += near
    assert got == want


def test_kernel_calls_are_bounded():
    import numpy as np

    from voxtable.operators import components

    ends = np.array([0, 5, 5, 900_000, 900_001, 900_400])
    runs = components._runs_of_tiles(ends, 1000)
    assert [a for a, _ in runs] + [5] == [0] + [b for _, b in runs] and all(ends[b] - ends[a] <= components._CELLS or b == a + 1 for a, b in runs)
    assert components._runs_of_tiles(ends, components._GRID + 1) == [(n, n + 1) for n in range(5)]
