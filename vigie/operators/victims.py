"""Wide victim slots to a long victims table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from vigie.functions.classes import keyword_class
from vigie.functions.scalars import as_number, number_text
from vigie.operators.joins import SALT_ROWS, sized, spread_join
from vigie.schemas import COUNT_COLUMNS, STATUS_COLUMNS
from vigie.session import stored

# Which value column each kind of slot column becomes.
VALUE_COLUMNS = {"Statut": "statut", "Nombre": "nombre"}


def _one_type(incidents: DataFrame, names: list[str]) -> list[Column]:
    """The columns in one type: numbers as they are, with text among them all as text."""
    numeric = [isinstance(incidents.schema[name].dataType, NumericType) for name in names]
    if all(numeric):
        return [F.col(name).cast("double").alias(name) for name in names]
    return [
        F.when(F.col(name).isNotNull(), number_text(name)).alias(name) if is_number else F.col(name)
        for name, is_number in zip(names, numeric)
    ]


def unpivot_victims(incidents: DataFrame, kind: str | None = None) -> DataFrame:
    """The victim slots as rows: six of one kind, or twelve with their ``type``.

    Kind, category and slot number are read from the column name. The value of a kind
    is called ``statut`` or ``nombre``; without a kind it is ``value``, which is text.
    """
    if kind is not None and kind not in VALUE_COLUMNS:
        raise ValueError(f"kind must be one of {tuple(VALUE_COLUMNS)}, not {kind!r}")
    names = {"Statut": STATUS_COLUMNS, "Nombre": COUNT_COLUMNS}.get(
        kind, STATUS_COLUMNS + COUNT_COLUMNS
    )
    value = VALUE_COLUMNS.get(kind, "value")
    wide = incidents.select("no_liste", *_one_type(incidents, names))
    key = F.col("key")
    columns = [
        F.col("no_liste"),
        F.when(key.contains("morts"), "Morts").otherwise("Blessés").alias("categorie"),
        F.col(value),
        F.when(key.contains("1"), 1).when(key.contains("2"), 2).otherwise(3).alias("groupe"),
    ]
    if kind is None:
        columns.append(F.when(key.contains("stat"), "Statut").otherwise("Nombre").alias("type"))
    return wide.unpivot("no_liste", names, "key", value).select(*columns)


def pair_victims(status: DataFrame, counts: DataFrame) -> DataFrame:
    """Status rows joined to count rows of the same incident, category and slot.

    Missing counts are dropped before the text is read as a number, so a count that
    cannot be read stays as NULL. A repeated incident number multiplies rows.
    """
    keys = ("no_liste", "categorie", "groupe")
    both = sized(status, counts.filter(F.col("nombre").isNotNull()), keys)
    return spread_join(*both, keys).select(
        "no_liste",
        "categorie",
        "statut",
        as_number("nombre", counts.schema["nombre"].dataType).alias("nombre"),
    )


def _paired_slots(rows: DataFrame) -> DataFrame:
    """Status and count of each slot side by side, in one pass and without a shuffle."""
    counts = [F.col(name) for name in COUNT_COLUMNS]
    slots = F.array(*[
        F.struct(
            F.lit("Morts" if "morts" in status else "Blessés").alias("categorie"),
            F.col(status).alias("statut"),
            F.col(count).isNotNull().alias("_known"),
            as_number(count, rows.schema[count].dataType).alias("nombre"),
        )
        for status, count in zip(STATUS_COLUMNS, COUNT_COLUMNS)
    ])
    return (
        rows.filter(F.coalesce(*[count.cast("string") for count in counts]).isNotNull())
        .select(*[name for name in ("no_liste", "date") if name in rows.columns], F.inline(slots))
        .filter("_known")
    )


def _numbers(rows: DataFrame) -> DataFrame:
    """Per incident number its rows ``n`` and, if rows have dates, its dates with their counts.

    The calendar bounds the dates of a number.
    """
    if "date" not in rows.columns:
        return rows.groupBy(F.col("no_liste").alias("_number")).agg(F.count(F.lit(1)).alias("n"))
    return (
        rows.groupBy(F.col("no_liste").alias("_number"), "date").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("_number")
        .agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("date", F.col("n").alias("times")))).alias("_dates"))
    )


def _joined_rows(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Each status row with each count row and each date of the same incident number, of some numbers.

    The wide rows of those numbers are stored, as they are read twice, and joined: a sixth of the
    long ones. A number that occurs k times gives k * k * k rows (k * k without dates), as
    asked for; a hot one is dealt over many tasks.
    """
    several = stored(
        rows.join(numbers, F.col("no_liste").eqNullSafe(F.col("_number")))
        .drop("_number", "date").withColumn("_n", F.when(F.col("n") > SALT_ROWS, F.col("n"))).drop("n"),
        "repeated",
    )
    counts = several.select("no_liste", *COUNT_COLUMNS, "_n").filter(
        F.coalesce(*[F.col(name).cast("string") for name in COUNT_COLUMNS]).isNotNull()
    )
    dates = [name for name in ("_dates",) if name in several.columns]
    joined = spread_join(several.select("no_liste", *STATUS_COLUMNS, *dates, "_n"), counts, ("no_liste",))
    if not dates:
        return joined
    names = ("no_liste", *STATUS_COLUMNS, *COUNT_COLUMNS)
    return (
        joined.select(*names, F.inline("_dates"))
        .select(*names, "date", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_time"))
        .drop("_time")
    )


def unique_numbers(incidents: DataFrame) -> bool:
    """Whether no incident number, missing or not, occurs twice: looked up now, on the numbers alone."""
    return _numbers(incidents.select("no_liste")).filter("n > 1").isEmpty()


def _checked_slots(rows: DataFrame) -> DataFrame:
    """One pass for the numbers that occur once, the join for the others.

    Only the numbers are shuffled to find the repeated ones; how they meet the rows is left
    to Spark, which broadcasts them when they are few. The rows of repeated numbers are stored here.
    """
    repeated = _numbers(rows.select("no_liste")).filter("n > 1").select("_number")
    single = rows.join(repeated, F.col("no_liste").eqNullSafe(F.col("_number")), "left_anti")
    several = _joined_rows(rows, _numbers(rows).filter("n > 1"))
    return _paired_slots(single).unionByName(_paired_slots(several))


def _slots(rows: DataFrame, unique_ids: bool | None) -> DataFrame:
    if unique_ids is None:
        return _checked_slots(rows)
    return _paired_slots(rows if unique_ids else _joined_rows(rows, _numbers(rows)))


def paired_victims(incidents: DataFrame, unique_ids: bool | None = None) -> DataFrame:
    """The rows ``pair_victims`` gives for the unpivoted slots, paired before the unpivot.

    A number that occurs k times pairs each of its statuses with each of its counts: k * k rows
    a slot. ``unique_ids`` is as in ``victims``.
    """
    rows = incidents.select("no_liste", *STATUS_COLUMNS, *COUNT_COLUMNS)
    return _slots(rows, unique_ids).select("no_liste", "categorie", "statut", "nombre")


def victims(incidents: DataFrame, unique_ids: bool | None = None) -> DataFrame:
    """One row per incident and victim group with a known count, with the actor group.

    A repeated ``no_liste`` pairs each status with each count and each date of that
    number. By default repeated numbers are looked for, and only those are joined. Pass True
    when the number is a key (one pass, no look, no shuffle) or False to join all rows without
    a look. On a key all three give the same rows; True on repeated numbers, which is not
    checked, pairs each row with itself only.
    """
    rows = incidents.select("no_liste", "date", *STATUS_COLUMNS, *COUNT_COLUMNS)
    return _slots(rows, unique_ids).select(
        "no_liste",
        "date",
        "categorie",
        "statut",
        keyword_class(F.col("statut")).alias("corps"),
        "nombre",
    )
