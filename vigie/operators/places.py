"""Counts per place and per region.

The counts take incident rows from ``locate_points``, or rows condensed before locating
(``condense_points``), which carry the number of incidents in ``n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigie import rules
from vigie.functions.classes import severity_id
from vigie.functions.scalars import number_text
from vigie.operators.classify import label_severity
from vigie.operators.trends import measure_sum


def _weight(points: DataFrame) -> str | None:
    return "n" if "n" in points.columns else None


def counts_by_place(points: DataFrame, measure: str) -> DataFrame:
    """Incidents, dead or injured per year and place, where there are any.

    ``year_key`` is the year as text, by which the drawn places are coloured.
    """
    year = F.col("annee").alias("year")
    label = F.concat_ws(
        " ",
        F.coalesce("point", F.lit("NA")),
        F.lit("-"),
        number_text("year"),
        F.lit(":"),
        number_text("value"),
        F.lit(measure),
    )
    return (
        points.groupBy(year, "longitude", "latitude", "point")
        .agg(measure_sum(measure, _weight(points)).alias("value"))
        .filter(F.col("value") > 0)
        .select(
            "year",
            "longitude",
            "latitude",
            "point",
            F.lit(measure).alias("variable"),
            "value",
            label.alias("label"),
            number_text("year").alias("year_key"),
        )
    )


def _severity(points: DataFrame) -> Column:
    known = "severity_id" in points.columns
    return F.col("severity_id") if known else severity_id().alias("severity_id")


def _counted(points: DataFrame, *keys: Column | str) -> DataFrame:
    """Dated incidents per year, severity and keys. Condensed rows are dated ones."""
    weight = _weight(points)
    if "date" in points.columns:
        points = points.filter(F.col("date").isNotNull())
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return points.groupBy(F.col("annee").alias("year"), _severity(points), *keys).agg(
        total.alias("n")
    )


def _of_year(df: DataFrame, year: float | str | None) -> DataFrame:
    """The year may be given as a number or as text."""
    return df if year is None else df.filter(F.col("year") == float(year))


def severity_by_place(
    points: DataFrame,
    year: float | str | None = None,
    severity: str | None = None,
    lang: str = "en",
) -> DataFrame:
    """Number of incidents per place for a year and a severity, named in ``lang``.

    Without a year or severity, all of them are kept.
    """
    counted = _of_year(_counted(points, "point", "latitude", "longitude"), year)
    if severity is not None:
        labels = [rules.translate(label, lang) for label in rules.SEVERITY_LABELS]
        chosen = labels.index(severity) + 1 if severity in labels else 0
        counted = counted.filter(F.col("severity_id") == chosen)
    return label_severity(counted, "severity_id", lang).select(
        "year", "severity", "severity_order", "point", "latitude", "longitude", "n"
    )


def severity_by_region(
    points: DataFrame,
    year: float | str | None = None,
    region: str | None = None,
    lang: str = "en",
) -> DataFrame:
    """Number of incidents per severity for a year and a first-level region.

    Without a year or region, all of them are kept.
    """
    counted = _of_year(_counted(points, "adm1_cod", "adm1_name"), year)
    if region is not None:
        counted = counted.filter(F.col("adm1_name") == region)
    return label_severity(counted, "severity_id", lang).select(
        "adm1_cod", "adm1_name", "year", "severity", "severity_order", "n"
    )


def highlight_region(boundaries: DataFrame, region: str) -> DataFrame:
    """Flag the first-level boundary rows of a region; a missing name stays unknown."""
    return boundaries.filter(F.col("level") == 1).withColumn(
        "myfill", F.col("Admin1_Nam") == region
    )
