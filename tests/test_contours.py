"""Contours against a plain walk through the cells, and against shapes whose lines are known."""

import math

import numpy as np
import pytest

from vigie.operators import contours

RASTER = "cell_x INT, cell_y INT, longitude DOUBLE, latitude DOUBLE, density DOUBLE"


def raster(spark, heights):
    """Rows of a height matrix; the grid is stretched so that axes cannot be mistaken."""
    return spark.createDataFrame(
        [(i, j, 2.0 * i, 10.0 + 3.0 * j, None if z is None else float(z)) for i, row in enumerate(heights) for j, z in enumerate(row)],
        RASTER).repartition(4)


def levels(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "level_no INT, level DOUBLE")


def plain_segments(heights, level):
    """Cell by cell: the edges crossed, joined so that the higher side is on the left."""
    out = []
    for i in range(len(heights) - 1):
        for j in range(len(heights[0]) - 1):
            corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            z = [heights[a][b] for a, b in corners]
            if any(v is None for v in z):
                continue
            starts, ends = [], []
            for k in range(4):
                (a, b), (c, d) = corners[k], corners[(k + 1) % 4]
                low, high = z[k], z[(k + 1) % 4]
                if (low >= level) != (high >= level):
                    share = (level - low) / (high - low)
                    point = (round(2 * (a + share * (c - a)), 9), round(10 + 3 * (b + share * (d - b)), 9))
                    (starts if low >= level else ends).append((k, point))
            if len(starts) == 1:
                out.append((starts[0][1], ends[0][1]))
            elif starts:
                middle = sum(z) / 4 >= level
                # A saddle: the higher corners are joined if the middle is high, else each is cut off.
                for k, point in starts:
                    partner = (k + 1) % 4 if middle else (k - 1) % 4
                    out.append((point, dict(ends)[partner]))
    return out


def plain_lines(segments):
    """Lines as lists of points; a closed one begins and ends with the same point."""
    after = dict(segments)
    assert len(after) == len(segments) == len(set(after.values()))
    heads = [a for a in after if a not in set(after.values())]
    lines, seen = [], set()
    for head in heads + sorted(after):
        if head in seen:
            continue
        line = [head]
        seen.add(head)
        while line[-1] in after and (len(line) == 1 or line[-1] != head):
            line.append(after[line[-1]])
            seen.add(line[-1])
        lines.append(line)
    return lines


def found_lines(df):
    lines = {}
    for row in sorted(df.collect(), key=lambda r: (r.level, r.ring, r.vertex_no)):
        lines.setdefault((row.level, row.ring, row.closed), []).append((row.vertex_no, (round(row.longitude, 9), round(row.latitude, 9))))
    for (_, _, closed), line in lines.items():
        assert [n for n, _ in line] == list(range(1, len(line) + 1))
        assert (line[0][1] == line[-1][1]) == closed
    return {key: [point for _, point in line] for key, line in lines.items()}


def turned(line):
    """A closed line from its smallest point; an open one as it is."""
    if line[0] != line[-1]:
        return tuple(line)
    body = line[:-1]
    at = body.index(min(body))
    return tuple(body[at:] + body[:at])


@pytest.mark.parametrize("seed", range(3))
def test_lines_equal_a_plain_walk(spark, seed):
    """Rough ground with saddles, closed and open lines, and a missing corner."""
    rng = np.random.default_rng(seed)
    heights = rng.integers(0, 12, (9, 8)).astype(float).tolist() if seed else (
        np.add.outer(np.sin(np.arange(14)), np.cos(np.arange(11) / 1.5)) + 2).round(6).tolist()
    if seed == 2:
        heights[4][3] = None
    values = (0.7, 1.9, 2.0, 3.1) if not seed else (2.5, 5.25, 5.5, 9.25)
    found = contours.hotspot_contours(raster(spark, heights), levels(spark, *values))
    lines = found_lines(found)
    for level in values:
        wanted = plain_lines(plain_segments(heights, level))
        assert sorted(turned(line) for (at, _, _), line in lines.items() if at == level) == sorted(map(turned, wanted))
    assert len(lines) == len({(level, ring) for level, ring, _ in lines})


def test_levels_at_corner_heights(spark):
    """Points of several edges coincide there; every segment is still in one line, once."""
    heights = np.random.default_rng(7).integers(0, 4, (8, 9)).astype(float).tolist()
    lines = found_lines(contours.hotspot_contours(raster(spark, heights), levels(spark, 2.0)))
    steps = sorted((a, b) for line in lines.values() for a, b in zip(line, line[1:]))
    assert steps == sorted(plain_segments(heights, 2.0))


def test_a_long_line(spark):
    """A winding wall gives one line of over a thousand vertices, in order."""
    n = 41
    heights = [[0.0] * n for _ in range(n)]
    # A wall every other column, joined at alternating ends.
    for i in range(1, n - 1):
        for j in range(1, n - 1):
            if i % 2 or j == (1 if i % 4 else n - 2):
                heights[i][j] = 1.0
    lines = found_lines(contours.hotspot_contours(raster(spark, heights), levels(spark, 0.5)))
    wanted = plain_lines(plain_segments(heights, 0.5))
    assert sorted(map(turned, lines.values())) == sorted(map(turned, wanted))
    assert max(map(len, lines.values())) > 1000


def test_higher_side_is_on_the_left(spark):
    """Lines around a hill run anticlockwise, around a hole clockwise."""
    x, y = np.meshgrid(np.arange(15), np.arange(15), indexing="ij")
    hill = np.exp(-((x - 7) ** 2 + (y - 7) ** 2) / 9.0)

    def area(line):
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(line, line[1:])) / 2

    for heights, sign in ((hill, 1), (1 - hill, -1)):
        lines = found_lines(contours.hotspot_contours(raster(spark, heights.tolist()), levels(spark, 0.5)))
        assert len(lines) == 1 and all(area(line) * sign > 0 for line in lines.values())


def test_round_levels(spark):
    def found(low, high, n=10):
        rows = contours.contour_levels(raster(spark, [[low, high]]), n).collect()
        assert [r.level_no for r in rows] == list(range(len(rows)))
        return [round(r.level, 12) for r in rows]

    # By hand: steps of 1, 2 or 5 times a power of ten that enclose the range.
    assert found(0.0, 1.0) == [round(k / 10, 12) for k in range(11)]
    assert found(0.3, 17.2) == [float(k) for k in range(0, 19, 2)]
    assert found(0.0, 0.0034) == [round(k * 0.0005, 12) for k in range(8)]
    assert found(-3.0, 4.0) == [round(-3 + k * 0.5, 12) for k in range(15)]
    assert found(2.0, 2.0) == []


def test_flat_empty_and_tiny_rasters(spark):
    for heights in ([], [[1.0]], [[1.0, 2.0]], [[3.0, 3.0], [3.0, 3.0]], [[None, None], [None, None]]):
        assert contours.hotspot_contours(raster(spark, heights)).count() == 0
    assert contours.hotspot_contours(raster(spark, [[0.0, 1.0], [1.0, 2.0]])).count() > 0
    assert all(math.isfinite(r.longitude) for r in contours.hotspot_contours(raster(spark, [[0.0, 1.0], [1.0, 2.0]])).collect())
