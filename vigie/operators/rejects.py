"""What the preparation leaves out or cannot read, counted by reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from vigie import rules
from vigie.functions.scalars import as_number, date_from_parts, to_number
from vigie.schemas import COUNT_COLUMNS

CORRUPT = "_corrupt"


def reasons(raw: DataFrame, origin: str = rules.KEPT_ORIGIN) -> dict[str, Column]:
    """Per reason the raw rows it holds for.

    The first four reasons drop a row, and the first that holds counts. The others are about
    cells of the rows that stay: the cell is read as missing.
    """
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)
    foreign = ~F.coalesce(F.col("origin") == origin, F.lit(False))
    incomplete = F.col("annee").isNull() | F.col("mois").isNull() | F.col("jour").isNull()
    impossible = date_from_parts("annee", "mois", "jour").isNull()
    kept = ~corrupt & ~foreign & ~incomplete & ~impossible
    found = {
        "corrupt row": corrupt,
        "other origin": ~corrupt & foreign,
        "date part missing": ~corrupt & ~foreign & incomplete,
        "no such date": ~corrupt & ~foreign & ~incomplete & impossible,
    }
    for cell, named in (("point_id", "point"), ("arrivee_id", "depart")):
        if cell in raw.columns:
            unread = F.col(named).isNotNull() & F.col(cell).isNotNull() & to_number(F.col(cell)).isNull()
            found[f"unreadable {cell}"] = kept & unread
    counts = [name for name in COUNT_COLUMNS if name in raw.columns]
    if counts:
        unread = F.lit(False)
        for name in counts:
            unread = unread | (F.col(name).isNotNull() & as_number(name, raw.schema[name].dataType).isNull())
        found["unreadable count"] = kept & unread
    return found


def _counted(raw: DataFrame, origin: str) -> list[Column]:
    return [F.count_if(F.coalesce(holds, F.lit(False))).alias(reason) for reason, holds in reasons(raw, origin).items()]


def rejected_rows(raw: DataFrame, origin: str = rules.KEPT_ORIGIN) -> DataFrame:
    """``reason`` and ``n`` for every reason, those that never hold with 0."""
    counted = raw.agg(*_counted(raw, origin))
    return counted.unpivot([], counted.columns, "reason", "n")


def observe_rejects(raw: DataFrame, observation: Observation, origin: str = rules.KEPT_ORIGIN) -> DataFrame:
    """The raw rows as they are; whatever is done with them first fills ``observation``, in the same pass.

    It holds ``rows`` and the count of each reason, and is best put right before ``clean_incidents``.
    """
    return raw.observe(observation, F.count(F.lit(1)).alias("rows"), *_counted(raw, origin))
