"""Outline texts read as rings, against outlines written out by hand and by a plain writer."""

import random

import pytest
from pyspark.sql import functions as F

from vigie.operators import geometry


def parts(spark, *texts):
    df = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i INT, wkt STRING")
    rows = df.select("i", geometry.parts_from_wkt(F.col("wkt")).alias("parts")).orderBy("i").collect()
    return [None if r.parts is None else [[[(p.lon, p.lat) for p in ring] for ring in part] for part in r.parts] for r in rows]


def test_polygons_and_multipolygons(spark):
    triangle = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.5), (0.0, 0.0)]
    hole = [(0.1, 0.1), (0.2, 0.1), (0.1, 0.2), (0.1, 0.1)]
    one, inside = "(0 0, 1 0, 0 1.5, 0 0)", "(0.1 0.1,0.2 0.1,0.1 0.2,0.1 0.1)"
    assert parts(spark, f"POLYGON({one})", f" polygon ( {one} , {inside} ) ", f"MULTIPOLYGON(({one}),({one},{inside}))",
                 f"SRID=4326; MultiPolygon (( {one} ) , ( {one}\n,\n{inside} ))") == [
        [[triangle]], [[triangle, hole]], [[triangle], [triangle, hole]], [[triangle], [triangle, hole]]]


def test_further_coordinates_and_notations(spark):
    assert parts(spark, "POLYGON Z((1 2 3, -4.5e1 +.5 6, 1 2 3))", "POLYGONM((1 2 3,1 2 4))") == [
        [[[(1.0, 2.0), (-45.0, 0.5), (1.0, 2.0)]]], [[[(1.0, 2.0), (1.0, 2.0)]]]]


@pytest.mark.parametrize("text", [
    None, "", "POINT(1 2)", "LINESTRING(0 0, 1 1)", "POLYGON", "POLYGON((0 0, x 1, 0 0))", "POLYGON((0 0, 1, 0 0))",
    "POLYGON((0 0,, 0 0))", "MULTIPOLYGON(((0 0, 1 1), ((0 0)))", "GEOMETRYCOLLECTION(POLYGON((0 0)))",
])
def test_unreadable_outlines_are_missing(spark, text):
    assert parts(spark, text) == [None]


def test_empty_outlines_have_no_parts(spark):
    assert parts(spark, "POLYGON EMPTY", "multipolygon empty") == [[], []]


def test_any_outline_comes_back(spark):
    rng = random.Random(5)
    gap = lambda: rng.choice(["", " ", "\n", "  "])
    point = lambda: (round(rng.uniform(-180, 180), 5), round(rng.uniform(-90, 90), 5))
    made, texts = [], []
    for _ in range(60):
        shape = [[[point() for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))]
        join = lambda items: "(" + gap() + (gap() + "," + gap()).join(items) + gap() + ")"
        text = [join([join([f"{x!r} {y!r}" for x, y in ring]) for ring in part]) for part in shape]
        made.append(shape)
        texts.append("POLYGON" + gap() + text[0] if len(shape) == 1 else "MULTIPOLYGON" + gap() + join(text))
    assert parts(spark, *texts) == made


def test_vertices_in_order_with_attributes(spark):
    rows = [(1, "Gao", "MULTIPOLYGON(((0 0,2 0,0 2,0 0),(.5 .5,.6 .5,.5 .6,.5 .5)),((5 5,6 5,5 6,5 5)))"), (2, None, "POLYGON EMPTY"), (3, "x", None)]
    df = spark.createDataFrame(rows, "level INT, part STRING, wkt STRING").withColumnRenamed("part", "Admin1_Nam")
    found = geometry.boundary_vertices(df)
    assert found.columns == ["level", "Admin1_Nam", "part", "ring", "hole", "position", "longitude", "latitude"]
    found = found.orderBy("part", "ring", "position").collect()
    assert [(r.part, r.ring, r.hole, r.position) for r in found] == [
        (p, r, r == 2, i) for p, r in ((1, 1), (1, 2), (2, 1)) for i in range(1, 5)]
    assert (found[1].longitude, found[1].latitude, found[1].Admin1_Nam) == (2.0, 0.0, "Gao")


def test_rings_feed_the_vertices_of_shapes(spark):
    shapes = spark.createDataFrame([("0", "POLYGON((0 0,1 0,0 1,0 0))")], "region STRING, wkt STRING")
    attributes = spark.createDataFrame([(1, "a")], "OBJECTID INT, nom STRING")
    rows = geometry.polygon_vertices(
        shapes.select("region", geometry.rings_from_wkt(F.col("wkt")).alias("rings")), attributes).collect()
    assert [(r.ring, r.position, r.longitude, r.latitude, r.nom) for r in rows] == [
        (1, 1, 0.0, 0.0, "a"), (1, 2, 1.0, 0.0, "a"), (1, 3, 0.0, 1.0, "a"), (1, 4, 0.0, 0.0, "a")]
