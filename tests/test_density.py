import math

import numpy as np
import pytest

from vigie.operators import density


def places(spark, points):
    return spark.createDataFrame(points, "longitude DOUBLE, latitude DOUBLE")


def brute(points, grid, extent=density.MAP_EXTENT):
    x, y = np.array(points).T
    m = len(x)

    def width(v):
        q25, q75 = np.percentile(v, [25, 75])
        return 1.06 * min(v.std(ddof=1), (q75 - q25) / 1.34) * m ** -0.2

    hx, hy = width(x), width(y)
    gx, gy = (np.linspace(*side, grid) for side in extent)
    return {
        (i, j): sum(
            math.exp(-(((gx[i] - a) / hx) ** 2) / 2 - (((gy[j] - b) / hy) ** 2) / 2)
            for a, b in zip(x, y)
        ) / (2 * math.pi * m * hx * hy)
        for i in range(grid) for j in range(grid)
    }


RANDOM = np.random.default_rng(3).normal((0, 15), (2, 3), (150, 2)).round(2)
POINTS = [tuple(point) for point in RANDOM.tolist()]


def test_against_brute_force(spark):
    """Rows spread over several tasks."""
    df = places(spark, POINTS + [(None, 1.0), (2.0, None)]).repartition(5)
    found = {(r.cell_x, r.cell_y): r.density
             for r in density.hotspot_density(df, grid=12).collect()}
    wanted = brute(POINTS, 12)
    assert found.keys() == wanted.keys()
    assert all(math.isclose(found[c], wanted[c], rel_tol=1e-9, abs_tol=1e-15) for c in wanted)


def test_grid_spans_the_extent(spark):
    rows = density.hotspot_density(places(spark, POINTS), 4, ((0.0, 3.0), (10.0, 16.0))).collect()
    assert sorted({r.longitude for r in rows}) == [0.0, 1.0, 2.0, 3.0]
    assert sorted({r.latitude for r in rows}) == [10.0, 12.0, 14.0, 16.0]


@pytest.mark.parametrize("points", [
    [],
    [(1.0, 2.0)],
    [(1.0, 2.0), (1.0, 3.0), (1.0, 4.0), (1.0, 5.0)],
    [(None, None), (1.0, 2.0)],
])
def test_no_spread_gives_no_rows(spark, points):
    assert density.hotspot_density(places(spark, points), 5).collect() == []


def test_quartiles_are_exact(spark):
    """With ties, a value that holds a third of the rows, and a dense core beside a far outlier."""
    rng = np.random.default_rng(5)
    axes = {
        "a": rng.normal(size=301).tolist() + [0.25] * 150,
        "b": rng.integers(0, 4, 77).astype(float).tolist(),
        "c": [1.0, 4.0],
        "d": (10 ** rng.uniform(-9, 9, 400)).tolist(),
        "e": [2.0],
        "f": rng.uniform(-12, 5, 500).tolist() + [999_999.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in axes.items() for v in vs],
                               "axis STRING, value DOUBLE").repartition(6)
    rows = {r.axis: r for r in density.axis_quartiles(df).collect()}
    assert rows.keys() == axes.keys()
    for axis, values in axes.items():
        row, wanted = rows[axis], np.percentile(values, [25, 75])
        assert row.m == len(values)
        assert np.allclose([row.q25, row.q75], wanted, rtol=1e-12)
        assert len(values) == 1 or math.isclose(row.sd, np.std(values, ddof=1), rel_tol=1e-9)


def test_quartiles_of_many_rows_are_exact(spark):
    """Enough rows that only those near the quartiles are sorted; with ties at and around them."""
    rng = np.random.default_rng(6)
    axes = {
        "a": rng.normal(size=20_001),
        "b": np.round(rng.normal(size=9_000), 1),
        "c": np.concatenate([np.full(3_000, 0.5), rng.uniform(0, 1, 6_001)]),
        "d": 10 ** rng.uniform(-9, 9, density.FEW),
        "e": np.full(5_000, 3.0),
        "f": rng.permutation(density.FEW - 1).astype(float),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in axes.items() for v in vs], "axis STRING, value DOUBLE").repartition(7)
    rows = {r.axis: r for r in density.axis_quartiles(df).collect()}
    for axis, values in axes.items():
        wanted = np.percentile(values, [25, 75])
        assert rows[axis].m == len(values)
        assert np.allclose([rows[axis].q25, rows[axis].q75], wanted, rtol=1e-12)
