"""Distance maps against an all-pairs search."""

import numpy as np

from voxtable.operators.distance import distance_map, lung_depth, voxel_features, volume_geometry

CASES = "case_id bigint, sz double, sy double, sx double, nz int, ny int, nx int"


def phantom(seed, shape, density):
    return np.random.default_rng(seed).random(shape) < density


def brute(mask, spacing):
    inside, outside = np.argwhere(mask), np.argwhere(~mask)
    out = {}
    for cell in inside:
        gaps = (outside - cell) * np.array(spacing)
        out[tuple(map(int, cell))] = float(np.sqrt((gaps**2).sum(1).min())) if len(outside) else None
    return out


def inputs(spark, masks, spacing):
    rows = [(n, *map(int, cell), 1, int(cell[2]) % 5) for n, mask in enumerate(masks) for cell in np.argwhere(mask)]
    voxels = spark.createDataFrame(rows, "case_id bigint, z int, y int, x int, lung int, lesion int")
    cases = spark.createDataFrame([(n, *spacing, *mask.shape) for n, mask in enumerate(masks)], CASES)
    return voxels, cases


def test_exact_over_tiles_and_anisotropic_spacing(spark):
    spacing = (2.5, 0.5, 1.25)
    masks = [phantom(1, (7, 9, 11), 0.9), phantom(2, (7, 9, 11), 0.99), np.ones((7, 9, 11), bool)]
    voxels, cases = inputs(spark, masks, spacing)
    expected = {(n, *cell): d for n, mask in enumerate(masks) for cell, d in brute(mask, spacing).items()}
    for tile in (4, 32):
        found = {(r.case_id, r.z, r.y, r.x): r for r in voxel_features(voxels, cases, tile).collect()}
        assert found.keys() == expected.keys()
        for key, want in expected.items():
            assert found[key].lesion == key[3] % 5
            got = found[key].dist_mm
            assert (got is None) == (want is None)
            assert want is None or abs(got - want) < 1e-9


def test_volume_border_is_not_background(spark):
    mask = np.ones((3, 3, 3), bool)
    mask[0, 0, 0] = False
    voxels, cases = inputs(spark, [mask], (1.0, 1.0, 1.0))
    far = lung_depth(voxels, cases).where("z = 2 and y = 2 and x = 2").first()
    assert abs(far.dist_mm - 12**0.5) < 1e-12


def test_two_dimensional_form(spark):
    mask = phantom(5, (1, 13, 17), 0.8)
    voxels, cases = inputs(spark, [mask], (1.0, 2.0, 3.0))
    got = distance_map(voxels, volume_geometry(cases), keys=["case_id", "z"], axes=["y", "x"], tile=4).collect()
    want = brute(mask[0], (2.0, 3.0))
    assert {(r.y, r.x): round(r.dist_mm, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_groups_share_a_kernel_call(spark):
    """No call per group of lines: volumes of other sizes and steps in one batch keep apart, and cells beyond a volume still raise."""
    import pytest

    from voxtable.operators.distance import distance_map

    rng = np.random.default_rng(17)
    shapes, steps = [(5, 9, 7), (9, 5, 7), (5, 9, 7), (1, 3, 20)], [(1.0, 2.0, 0.5), (3.0, 0.5, 1.0), (0.25, 1.0, 4.0), (1.0, 1.0, 1.0)]
    masks = [rng.random(s) < 0.85 for s in shapes] + [np.ones((2, 2, 2), bool)]
    rows = [(i, int(z), int(y), int(x)) for i, m in enumerate(masks) for z, y, x in np.argwhere(m)]
    cells = spark.createDataFrame(rows, "case_id long, z int, y int, x int").coalesce(1)
    sizes = [(i, *s, *m.shape) for i, (s, m) in enumerate(zip([*steps, (1.0, 1.0, 1.0)], masks))]
    geometry = spark.createDataFrame(sizes, "case_id long, step_z double, step_y double, step_x double, len_z int, len_y int, len_x int")
    df = distance_map(cells, geometry, tile=4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    got = {tuple(r)[:4]: r.dist_mm for r in df.collect()}
    assert set(got) == set(rows) and all(got[r] is None for r in rows if r[0] == 4)
    for i, m in enumerate(masks[:4]):
        outside = np.argwhere(~m) * steps[i]
        for cell in np.argwhere(m):
            want = np.sqrt((((cell * steps[i]) - outside) ** 2).sum(axis=1).min())
            assert abs(got[(i, *map(int, cell))] - want) < 1e-9
    for bad in (-1, 4):
        with pytest.raises(Exception, match="do not fit a length"):
            distance_map(spark.createDataFrame([(4, bad, 0, 0)], cells.schema), geometry, tile=4).collect()
