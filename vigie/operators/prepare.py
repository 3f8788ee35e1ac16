"""From raw incidents and places to clean, located incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vigie import rules
from vigie.functions.classes import severity_id
from vigie.functions.scalars import as_number, date_from_parts, to_number
from vigie.rules import PlaceOverride
from vigie.schemas import LOCALITE_COLUMNS

LINE_COLUMNS = ("depart_id", "depart", "arrivee_id", "arrivee")
POINT_COLUMNS = ("point_id", "point")


def prepare_localities(raw: DataFrame) -> DataFrame:
    """The places with short names, a numeric id and a French place type.

    A place type outside the known ones has no French label; a missing type does.
    """
    kind = F.col("type")
    type_fr = F.when(kind.isNull(), rules.MISSING_TYPE_FR)
    for english, french in rules.PLACE_TYPES_FR:
        type_fr = type_fr.when(kind == english, french)
    return (
        raw.select(*[F.col(old).alias(new) for old, new in LOCALITE_COLUMNS.items()])
        .withColumn("type_fr", type_fr)
        .withColumns({
            "id": to_number(F.col("id")),
            "type": F.coalesce(kind, F.lit(rules.MISSING_TYPE)),
        })
    )


def clean_incidents(raw: DataFrame, origin: str = rules.KEPT_ORIGIN) -> DataFrame:
    """Incidents of one origin that carry a valid date, with that date."""
    return (
        raw.filter(F.col("origin") == origin)
        .withColumn("date", date_from_parts("annee", "mois", "jour"))
        .filter(F.col("date").isNotNull())
    )


def apply_place_overrides(
    df: DataFrame, overrides: Sequence[PlaceOverride] = rules.PLACE_OVERRIDES
) -> DataFrame:
    """Force coordinates and name on listed places.

    A row without a place name loses all three, even when its id matched a place:
    comparing a missing name gives a missing value, not "no match".
    """
    point = F.col("point")
    columns = {}
    for name in ("longitude", "latitude", "nom"):
        value = F.when(point.isNull(), F.lit(None))
        for override in reversed(overrides):
            value = value.when(point == override.point, F.lit(getattr(override, name)))
        columns[name] = value.otherwise(F.col(name))
    return df.withColumns(columns) if overrides else df


def _attach_places(
    rows: DataFrame, localites: DataFrame, overrides: Sequence[PlaceOverride]
) -> DataFrame:
    """Left join on the place id, where a missing id matches a missing id.

    No broadcast is forced: Spark broadcasts the places when their size is below its
    threshold, and otherwise runs a shuffled join whose hot ids adaptive execution splits.
    """
    places = localites.withColumnRenamed("id", "_place_id")
    joined = rows.join(places, F.col("id").eqNullSafe(F.col("_place_id")), "left")
    return apply_place_overrides(joined.drop("_place_id"), overrides)


def point_rows(incidents: DataFrame) -> DataFrame:
    """Incidents with a named place, with its id, before the places are attached."""
    return (
        incidents.filter(F.col("annee").isNotNull() & F.col("point").isNotNull())
        .drop(*LINE_COLUMNS)
        .withColumn("point_id", to_number(F.col("point_id")))
        .withColumnRenamed("point_id", "id")
    )


def line_rows(incidents: DataFrame) -> DataFrame:
    """Incidents between two places as two rows, before the places are attached.

    Both ends come from one pass over the incidents. Only the departure must be named.
    """
    depart_id = as_number("depart_id", incidents.schema["depart_id"].dataType)
    ends = F.array(
        F.struct(depart_id.alias("id"), F.col("depart").alias("point"),
                 F.lit("départ").alias("position")),
        F.struct(to_number(F.col("arrivee_id")).alias("id"), F.col("arrivee").alias("point"),
                 F.lit("arrivée").alias("position")),
    )
    dropped = LINE_COLUMNS + POINT_COLUMNS
    kept = [name for name in incidents.columns if name not in dropped]
    return (
        incidents.filter(F.col("annee").isNotNull() & F.col("depart").isNotNull())
        .select(*kept, F.inline(ends))
    )


def locate_points(
    incidents: DataFrame,
    localites: DataFrame,
    overrides: Sequence[PlaceOverride] = rules.PLACE_OVERRIDES,
) -> DataFrame:
    """Incidents with a named place, with that place's attributes."""
    return _attach_places(point_rows(incidents), localites, overrides)


def locate_lines(
    incidents: DataFrame,
    localites: DataFrame,
    overrides: Sequence[PlaceOverride] = rules.PLACE_OVERRIDES,
) -> DataFrame:
    """Incidents between two places as two rows, departure and arrival, with their attributes."""
    return _attach_places(line_rows(incidents), localites, overrides)


def condense_points(incidents: DataFrame, by_severity: bool = False) -> DataFrame:
    """Incidents with a named place, summed up per year and place before locating.

    The result goes through ``locate_points`` like incident rows do and the place
    counts accept it. Its ``n`` says how many incidents a row stands for. It holds one
    row per place and year (and severity), so a place with a large share of all
    incidents reaches the join as a handful of rows.
    """
    keys = [F.col("annee"), F.col("point_id"), F.col("point")]
    if by_severity:
        incidents = incidents.filter(F.col("date").isNotNull())
        keys.append(severity_id().alias("severity_id"))
    sums = [
        F.sum(name).alias(name)
        for name in ("nbr_morts", "nbr_blesses")
        if name in incidents.columns
    ]
    return (
        incidents.filter(F.col("point").isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), *sums)
    )
