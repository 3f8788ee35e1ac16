"""Boundary outlines as vertex rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigie.functions.scalars import as_number


def polygon_vertices(shapes: DataFrame, attributes: DataFrame) -> DataFrame:
    """The outline vertices of each shape in order, with the shape's attributes.

    ``shapes`` has ``region`` and ``rings``, an array of rings of ``lon``/``lat``
    structs; regions count from 0, the ``OBJECTID`` of the attributes from 1. The join
    runs on whole shapes, before the vertices are spread out.
    """
    region = as_number("region", shapes.schema["region"].dataType)
    described = attributes.withColumn("_region", (F.col("OBJECTID") - 1).cast("double")).drop(
        "OBJECTID"
    )
    others = [name for name in described.columns if name != "_region"]
    return (
        shapes.select(region.alias("region"), "rings")
        .join(described, F.col("region").eqNullSafe(F.col("_region")), "left")
        .select("region", *others, F.posexplode("rings").alias("ring", "_vertices"))
        .select("region", "ring", *others, F.posexplode("_vertices").alias("position", "_vertex"))
        .select(
            "region",
            (F.col("ring") + 1).alias("ring"),
            (F.col("position") + 1).alias("position"),
            F.col("_vertex.lon").alias("longitude"),
            F.col("_vertex.lat").alias("latitude"),
            *others,
        )
    )


OUTLINE = "(?is)^\\s*(?:SRID\\s*=\\s*\\d+\\s*;)?\\s*(MULTI)?POLYGON\\s*(?:ZM|Z|M)?\\s*(EMPTY|\\(.*\\))\\s*$"


def parts_from_wkt(wkt: Column) -> Column:
    """The rings of an outline text: per part its rings, per ring its points (``lon``, ``lat``).

    Reads polygons and multipolygons, the first ring of a part being its outer one; further
    coordinates of a point are left out, an empty outline has no parts. Text of another kind, or with a
    point that cannot be read, gives NULL.
    """
    wkt = F.regexp_replace(wkt, "\\s+", " ")
    several = F.regexp_extract(wkt, OUTLINE, 1) != ""
    body = F.trim(F.regexp_extract(wkt, OUTLINE, 2))
    # What is left between the brackets that enclose all parts, of which a polygon has one.
    inner = F.when(several, F.regexp_replace(body, "^\\(\\s*\\(\\s*\\(|\\)\\s*\\)\\s*\\)$", "")).otherwise(
        F.regexp_replace(body, "^\\(\\s*\\(|\\)\\s*\\)$", ""))
    texts = F.when(several, F.split(inner, "\\)\\s*\\)\\s*,\\s*\\(\\s*\\(")).otherwise(F.array(inner))

    def point(text: Column) -> Column:
        cells = F.split(F.trim(text), "\\s+")
        return F.struct(
            F.get(cells, F.lit(0)).try_cast("double").alias("lon"), F.get(cells, F.lit(1)).try_cast("double").alias("lat"))

    def ring(text: Column) -> Column:
        return F.transform(F.split(text, ","), point)

    parts = F.transform(texts, lambda part: F.transform(F.split(part, "\\)\\s*,\\s*\\("), ring))
    readable = F.forall(parts, lambda rings: F.forall(rings, lambda points: F.forall(
        points, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())))
    empty = F.array().cast("array<array<array<struct<lon:double,lat:double>>>>")
    return F.when(F.upper(body) == "EMPTY", empty).when(wkt.rlike(OUTLINE) & readable, parts)


def rings_from_wkt(wkt: Column) -> Column:
    """All rings of an outline text one after the other, as ``polygon_vertices`` takes them."""
    return F.flatten(parts_from_wkt(wkt))


def boundary_vertices(boundaries: DataFrame, wkt: str = "wkt") -> DataFrame:
    """The vertices of every outline in order: part, ring (both from 1), whether it is a hole, and position.

    The other columns stay. Outlines that are missing, empty or cannot be read give no rows.
    """
    others = [name for name in boundaries.columns if name != wkt]
    return (
        boundaries.select(*others, F.posexplode(parts_from_wkt(F.col(wkt))).alias("_part", "_rings"))
        .select(*others, "_part", F.posexplode("_rings").alias("_ring", "_points"))
        .select(*others, "_part", "_ring", F.posexplode("_points").alias("_position", "_point"))
        .select(
            *others,
            (F.col("_part") + 1).alias("part"),
            (F.col("_ring") + 1).alias("ring"),
            (F.col("_ring") > 0).alias("hole"),
            (F.col("_position") + 1).alias("position"),
            F.col("_point.lon").alias("longitude"),
            F.col("_point.lat").alias("latitude"),
        )
    )
