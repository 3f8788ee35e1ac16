"""Contour lines of a raster: level segments per grid cell, linked to ordered rings.

A cell's four corners meet in one shuffle by cell number, and each level that lies between them
cuts its edges (marching squares). A segment keeps the higher side on its left, so every crossed
edge ends one segment and begins the next. Pointer doubling then numbers the vertices of all lines
at once, in as many rounds as the logarithm of the longest line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigie.session import stored

LEVELS = 10

# --- fixed values: where the level leaves a cell ------------------------------
# Corners are numbered 0 (x, y), 1 (x + 1, y), 2 (x + 1, y + 1), 3 (x, y + 1); edge k runs from corner
# k to corner k + 1. Per set of corners at or above the level (corner k counts 2 ** k): the edges at
# which segments begin and end, with the higher side on the left. The sets 5 and 10 are saddles;
# the second list holds where the middle of the cell is at or above the level.
SEGMENTS = {
    1: ((0, 3),), 2: ((1, 0),), 3: ((1, 3),), 4: ((2, 1),), 5: ((0, 3), (2, 1)), 6: ((2, 0),), 7: ((2, 3),),
    8: ((3, 2),), 9: ((0, 2),), 10: ((1, 0), (3, 2)), 11: ((1, 2),), 12: ((3, 1),), 13: ((0, 1),), 14: ((3, 0),),
}
SADDLES = {5: ((0, 1), (2, 3)), 10: ((1, 2), (3, 0))}


def contour_levels(raster: DataFrame, n: int = LEVELS, value: str = "density") -> DataFrame:
    """``level_no`` and ``level``: about ``n`` round numbers over the raster's range, none if it is flat.

    Steps are 1, 2 or 5 times a power of ten, the one nearest to the range's ``n``-th part with a
    leaning to larger steps; the outermost levels enclose the range.
    """
    low, high = F.min(value), F.max(value)
    part = (F.col("high") - F.col("low")) / n
    base = F.pow(F.lit(10.0), F.floor(F.log10("part")))
    step = (
        F.when(10 * F.col("base") - F.col("part") < 1.5 * (F.col("part") - 5 * F.col("base")), 10 * F.col("base"))
        .when(5 * F.col("base") - F.col("part") < 2.75 * (F.col("part") - 2 * F.col("base")), 5 * F.col("base"))
        .when(2 * F.col("base") - F.col("part") < 1.5 * (F.col("part") - F.col("base")), 2 * F.col("base"))
        .otherwise(F.col("base"))
    )
    first = F.floor(F.col("low") / F.col("step") + 1e-7)
    last = F.ceil(F.col("high") / F.col("step") - 1e-7)
    return (
        raster.agg(low.alias("low"), high.alias("high"))
        .filter("high > low")
        .withColumn("part", part).withColumn("base", base).withColumn("step", step)
        .select("step", F.explode(F.sequence(first, last)).alias("number"), first.alias("first"))
        .select((F.col("number") - F.col("first")).cast("int").alias("level_no"), (F.col("number") * F.col("step")).alias("level"))
    )


def _cells(raster: DataFrame, value: str) -> DataFrame:
    """One row per cell with its four corners; cells that lack one are left out."""
    places = ((0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1))
    corner = F.struct(F.col(value).alias("z"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    spread = F.array(*[
        F.struct(F.lit(k).alias("corner"), (F.col("cell_x") - dx).alias("i"), (F.col("cell_y") - dy).alias("j"), corner.alias("at"))
        for k, dx, dy in places
    ])
    found = [F.max(F.when(F.col("corner") == k, F.col("at"))).alias(f"c{k}") for k in range(4)]
    whole = F.lit(True)
    for k in range(4):
        whole = whole & F.col(f"c{k}.z").isNotNull()
    return raster.select(F.inline(spread)).groupBy("i", "j").agg(*found).filter(whole)


def contour_segments(
    raster: DataFrame, levels: DataFrame | None = None, value: str = "density"
) -> DataFrame:
    """``level``, the crossed edges and the end points of every segment of every level.

    ``raster`` holds ``cell_x``, ``cell_y``, ``longitude``, ``latitude`` and the value at each grid
    point. A corner at a level counts as above it. ``edge_a`` and ``edge_b`` number the crossed grid
    edges, the same from both cells that share one.
    """
    levels = contour_levels(raster, value=value) if levels is None else levels
    # A few levels, which travel as one array.
    held = levels.agg(F.sort_array(F.collect_list(F.struct("level_no", "level"))).alias("levels")).scalar()
    heights = [F.col(f"c{k}.z") for k in range(4)]
    crossing = F.filter("levels", lambda l: (l["level"] > F.least(*heights)) & (l["level"] <= F.greatest(*heights)))
    cells = _cells(raster, value).withColumn("levels", held).select("i", "j", "c0", "c1", "c2", "c3", F.inline(crossing))
    level = F.col("level")
    above = sum((F.when(F.col(f"c{k}.z") >= level, 2 ** k).otherwise(0) for k in range(4)), F.lit(0))
    middle = sum((F.col(f"c{k}.z") for k in range(1, 4)), F.col("c0.z")) / 4 >= level

    def pairs(found: tuple[tuple[int, int], ...]) -> Column:
        return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in found])

    chosen = F.lit(None)
    for case, found in SEGMENTS.items():
        same = F.col("above") == case
        if case in SADDLES:
            chosen = F.when(same & middle, pairs(SADDLES[case])).when(same, pairs(found)).otherwise(chosen)
        else:
            chosen = F.when(same, pairs(found)).otherwise(chosen)
    rows = cells.withColumn("above", above).withColumn("pairs", chosen)

    def edge(k: Column) -> Column:
        """Grid edges: 2 per grid point, towards larger x (even) and larger y (odd)."""
        x = F.col("i").cast("long") + F.when(k == 1, 1).otherwise(0)
        y = F.col("j").cast("long") + F.when(k == 2, 1).otherwise(0)
        return ((x * F.lit(1 << 31) + y) * 2 + F.when((k == 1) | (k == 3), 1).otherwise(0)).cast("long")

    def point(k: Column) -> Column:
        # From the end of smaller x or y to the other, so that both cells give the same point.
        ends = {0: (0, 1), 1: (1, 2), 2: (3, 2), 3: (0, 3)}
        found = F.lit(None)
        for number, (p, q) in ends.items():
            a, b = F.col(f"c{p}"), F.col(f"c{q}")
            share = (level - a["z"]) / (b["z"] - a["z"])
            found = F.when(k == number, F.struct(
                (a["x"] + share * (b["x"] - a["x"])).alias("x"), (a["y"] + share * (b["y"] - a["y"])).alias("y"),
            )).otherwise(found)
        return found

    a, b = F.col("a"), F.col("b")
    return (
        rows.select("*", F.inline("pairs"))
        .select("level_no", "level", edge(a).alias("edge_a"), edge(b).alias("edge_b"), point(a).alias("p"), point(b).alias("q"))
        .select(
            "level_no", "level", "edge_a", "edge_b", F.col("p.x").alias("from_longitude"), F.col("p.y").alias("from_latitude"),
            F.col("q.x").alias("to_longitude"), F.col("q.y").alias("to_latitude"),
        )
    )


def _linked(links: DataFrame) -> DataFrame:
    """Every vertex of the lines with its line and how many steps it is before the line's last vertex.

    ``links`` are (line set, vertex, the vertex after it), at most one each way. Each round doubles the
    steps that a row's pointer spans, by one join; the smallest vertex on the way, and the end of an
    open line, are carried along. Only whether anything changed reaches the driver.
    """
    follow = links.select("level_no", F.col("edge_a").alias("vertex"), F.col("edge_b").alias("next"))
    last = links.select("level_no", F.col("edge_b").alias("vertex")).join(
        follow.select("level_no", "vertex"), ["level_no", "vertex"], "left_anti")
    state = stored(
        follow.unionByName(last.withColumn("next", F.lit(None).cast("long"))).select(
            "level_no", "vertex", "next", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("span"),
            F.col("vertex").alias("low"), F.lit(0).cast("long").alias("low_at"),
            F.when(F.col("next").isNull(), F.col("vertex")).alias("last"), F.lit(False).alias("changed"),
        ),
        "contours",
    )
    while True:
        onward = state.select(
            F.col("level_no").alias("_set"), F.col("vertex").alias("_vertex"), F.col("next").alias("_next"),
            F.col("span").alias("_span"), F.col("low").alias("_low"), F.col("low_at").alias("_low_at"), F.col("last").alias("_last"))
        joined = state.join(onward, (F.col("level_no") == F.col("_set")) & (F.col("next") == F.col("_vertex")), "left")
        lower, on = F.col("_low") < F.col("low"), F.col("next").isNotNull()
        state = stored(
            joined.select(
                "level_no", "vertex", F.col("_next").alias("next"), (F.col("span") + F.coalesce("_span", F.lit(0))).alias("span"),
                F.least("low", "_low").alias("low"),
                F.when(lower, F.col("span") + F.col("_low_at")).otherwise(F.col("low_at")).alias("low_at"),
                F.coalesce("last", "_last").alias("last"),
                (F.coalesce(lower, F.lit(False)) | (on & F.col("_next").isNull())).alias("changed"),
            ),
            "contours",
        )
        if state.filter("changed").isEmpty():
            break
    # An open line is known by its end; a closed one, which has none, by its smallest vertex.
    return state.select(
        "level_no", "vertex", F.col("last").isNull().alias("closed"), F.coalesce("last", "low").alias("line"),
        F.when(F.col("last").isNull(), F.col("low_at")).otherwise(F.col("span")).alias("before"))


def link_segments(segments: DataFrame) -> DataFrame:
    """``level``, ``ring``, ``closed``, ``vertex_no``, ``longitude``, ``latitude``: the segments as ordered lines.

    Rings of a level are numbered from 1 by their smallest vertex, a line's vertices from 1. A closed
    ring begins and ends at its smallest vertex; a line that leaves the grid is open, with the higher side
    on its left. The segments are stored first.
    """
    held = stored(segments, "segments")
    places = held.select(
        "level_no", F.col("level").alias("level"), F.col("edge_a").alias("vertex"),
        F.col("from_longitude").alias("longitude"), F.col("from_latitude").alias("latitude"),
    ).unionByName(held.select(
        "level_no", "level", F.col("edge_b").alias("vertex"), F.col("to_longitude").alias("longitude"),
        F.col("to_latitude").alias("latitude"),
    )).dropDuplicates(["level_no", "vertex"])
    linked = _linked(held.select("level_no", "edge_a", "edge_b"))
    lines = linked.groupBy("level_no", "closed", "line").agg(
        F.count(F.lit(1)).alias("n"), F.min("vertex").alias("first"))
    lines = lines.withColumn("ring", F.row_number().over(W.partitionBy("level_no").orderBy("first", "line")))
    # Steps to the smallest vertex of a closed ring, to the end of an open line.
    place = F.when(F.col("closed"), F.pmod(F.col("n") - F.col("before"), F.col("n")) + 1).otherwise(F.col("n") - F.col("before"))
    rows = (
        linked.join(lines, ["level_no", "closed", "line"])
        .join(places, ["level_no", "vertex"])
        .withColumn("vertex_no", place)
    )
    number, after = F.col("vertex_no").cast("int"), (F.col("n") + 1).cast("int")
    again = F.when(F.col("closed") & (number == 1), F.array(number, after)).otherwise(F.array(number))
    return rows.select(
        "level", F.col("ring").cast("int").alias("ring"), "closed", F.explode(again).alias("vertex_no"), "longitude", "latitude")


def hotspot_contours(raster: DataFrame, levels: DataFrame | None = None, value: str = "density") -> DataFrame:
    """The level lines of a raster (``contour_segments``, linked). A flat or empty raster has none."""
    return link_segments(contour_segments(raster, levels, value))
