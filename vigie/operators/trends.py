"""Counts over time: per month, per week, and running totals.

The fact rows are summed up first, with partial sums before the shuffle. Reshaping and
running totals then see one row per period and class, a number the calendar bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigie.functions import classes
from vigie.functions.scalars import month_start, week_of_year
from vigie.operators.classify import display_category

VARIABLES = ("total", "location", "type", "deadly")
CRITERIA = ("total", "location", "type")
STATISTICS = ("incidents", "cumsum_year", "cumsum_all")
MEASURES = ("incidents", "dead", "injured")

_CLASSES = {
    "total": lambda: F.lit("Total"),
    "location": classes.location_class,
    "type": classes.type_class,
    "deadly": classes.deadly_class,
}
_MEASURED = {"dead": "nbr_morts", "injured": "nbr_blesses"}
_UP_TO_HERE = (W.unboundedPreceding, W.currentRow)


def one_of(value: str, domain: tuple[str, ...], name: str) -> str:
    if value not in domain:
        raise ValueError(f"{name} must be one of {domain}, not {value!r}")
    return value


def measure_sum(measure: str, weight: str | None = None) -> Column:
    """A measure over a group as a double; a sum of nothing is 0.

    ``weight`` names the column that says how many incidents a row stands for.
    """
    one_of(measure, MEASURES, "measure")
    if measure == "incidents":
        total = F.count(F.lit(1)) if weight is None else F.sum(weight)
        return total.cast("double")
    return F.coalesce(F.sum(_MEASURED[measure]), F.lit(0.0)).cast("double")


def _month() -> Column:
    return month_start("year", "month")


def _counted(incidents: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Incidents per month and combination of the named classes."""
    keys = [_CLASSES[name]().alias(name) for name in names]
    return incidents.groupBy(
        F.col("annee").alias("year"), F.col("mois").alias("month"), *keys
    ).agg(F.count(F.lit(1)).alias("incidents"))


def monthly_by_dimension(
    incidents: DataFrame, variable: str, rollup: bool = False
) -> DataFrame:
    """Incidents per month, split by one variable.

    By default a month and category has one row for every combination of the other
    variables. ``rollup`` gives one row each, the height of the drawn bar.
    """
    one_of(variable, VARIABLES, "variable")
    if rollup:
        date = month_start("annee", "mois")
        rows = incidents.groupBy(
            date.alias("date"), _CLASSES[variable]().alias("category")
        ).agg(F.count(F.lit(1)).alias("incidents"))
    else:
        rows = _counted(incidents, VARIABLES).withColumns(
            {"date": _month(), "category": F.col(variable)}
        )
    rows = rows.select("date", "incidents", F.lit(variable).alias("variable"), "category")
    return display_category(rows)


def monthly_all_dimensions(incidents: DataFrame, rollup: bool = False) -> DataFrame:
    """The rows of ``monthly_by_dimension`` for every variable, from one pass over the incidents.

    The incidents are counted per month and combination of all classes, in one shuffle. What the
    variables are split from, and with ``rollup`` grouped by, are these few counts.
    """
    counted = _counted(incidents, VARIABLES).withColumn("date", _month())
    if rollup:
        sets = [("date", variable) for variable in VARIABLES]
        summed = counted.groupingSets(sets, "date", *VARIABLES).agg(
            F.sum("incidents").alias("incidents"), *[F.grouping(name).alias(f"_{name}") for name in VARIABLES])
        variable, category = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name in VARIABLES:
            variable = F.when(F.col(f"_{name}") == 0, name).otherwise(variable)
            category = F.when(F.col(f"_{name}") == 0, F.col(name)).otherwise(category)
        rows = summed.select("date", "incidents", variable.alias("variable"), category.alias("category"))
    else:
        splits = F.array(*[
            F.struct(F.lit(name).alias("variable"), F.col(name).alias("category")) for name in VARIABLES
        ])
        rows = counted.select("date", "incidents", F.inline(splits))
    return display_category(rows)


def running_all(incidents: DataFrame) -> DataFrame:
    """The rows of ``running_counts`` for every criterion and statistic, from one pass over the incidents.

    Both running sums pass over the same few counts; each count then gives a row per statistic.
    """
    splits = F.array(*[
        F.struct(F.lit(name).alias("criterion"), F.col(name).alias("category")) for name in CRITERIA
    ])
    counted = _counted(incidents, CRITERIA).withColumn("date", _month())
    rows = display_category(
        counted.select("year", "month", "date", "location", "type", "incidents", F.inline(splits)))
    order = ("month", "location", "type")
    in_year = W.partitionBy("criterion", "category", "year").orderBy(*order).rowsBetween(*_UP_TO_HERE)
    overall = W.partitionBy("criterion", "category").orderBy("year", *order).rowsBetween(*_UP_TO_HERE)
    values = (F.col("incidents"), F.sum("incidents").over(in_year), F.sum("incidents").over(overall))
    named = rows.withColumns({f"_{name}": value for name, value in zip(STATISTICS, values)})
    statistics = F.array(*[
        F.struct(F.lit(name).alias("variable"), F.col(f"_{name}").alias("nombre")) for name in STATISTICS
    ])
    return named.select(
        "year", "month", "date", "criterion", "category", "category_order", F.inline(statistics))


def running_counts(incidents: DataFrame, criterion: str, statistic: str) -> DataFrame:
    """Per month: simple count, running count in the year, or running count overall.

    A month and category keeps one row per location and type; the running sums pass
    through these rows in that order.
    """
    one_of(criterion, CRITERIA, "criterion")
    one_of(statistic, STATISTICS, "statistic")
    rows = display_category(
        _counted(incidents, CRITERIA).withColumns({
            "date": _month(),
            "criterion": F.lit(criterion),
            "category": F.col(criterion),
            "variable": F.lit(statistic),
        })
    )
    order = ("month", "location", "type")
    frames = {
        "cumsum_year": W.partitionBy("year", "category").orderBy(*order),
        "cumsum_all": W.partitionBy("category").orderBy("year", *order),
    }
    value = F.col("incidents")
    if statistic != "incidents":
        value = F.sum("incidents").over(frames[statistic].rowsBetween(*_UP_TO_HERE))
    return rows.withColumn("nombre", value).select(
        "year", "month", "date", "criterion", "category", "category_order", "variable", "nombre"
    )


def _measure_columns(measure: str) -> dict[str, Column]:
    return {"variable": F.lit(measure), "id": F.lit(MEASURES.index(measure) + 1)}


def cumulative_by_month(incidents: DataFrame, measure: str) -> DataFrame:
    """Incidents, dead or injured per month, with the running total overall."""
    window = W.partitionBy("variable").orderBy("year", "month").rowsBetween(*_UP_TO_HERE)
    return (
        incidents.groupBy(F.col("annee").alias("year"), F.col("mois").alias("month"))
        .agg(measure_sum(measure).alias("value"))
        .withColumns({"date": _month(), **_measure_columns(measure)})
        .withColumn("cumsum", F.sum("value").over(window))
        .select("date", "variable", "id", "value", "cumsum")
    )


def cumulative_by_week(incidents: DataFrame, measure: str) -> DataFrame:
    """Incidents, dead or injured per week, with the running total in the year."""
    window = W.partitionBy("year", "variable").orderBy("week").rowsBetween(*_UP_TO_HERE)
    return (
        incidents.groupBy(
            F.col("annee").alias("year"), week_of_year(F.col("date")).alias("week")
        )
        .agg(measure_sum(measure).alias("value"))
        .withColumns(_measure_columns(measure))
        .withColumn("cumsum", F.sum("value").over(window))
        .select("year", "week", "variable", "id", "value", "cumsum")
    )
