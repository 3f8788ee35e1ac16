"""Incident classes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from vigie import rules


def location_class() -> Column:
    """``Point`` when a place is named, else ``Ligne`` for two named ends, else ``ND``."""
    return (
        F.when(F.col("point").isNotNull(), "Point")
        .when(F.col("depart").isNotNull() & F.col("arrivee").isNotNull(), "Ligne")
        .otherwise(rules.UNKNOWN)
    )


def type_class() -> Column:
    """The two named incident types; all else, also a missing type, is ``Autre``."""
    named = F.col("type_incident").isin("Attaque", "Affrontement")
    return F.when(named, F.col("type_incident")).otherwise("Autre")


def deadly_class() -> Column:
    """Whether the incident is known to have killed."""
    return F.when(F.col("nbr_morts") > 0, "Deadly").otherwise("Not deadly")


def severity_id(dead: str = "nbr_morts", injured: str = "nbr_blesses") -> Column:
    """1 to 4 from dead and injured; a missing number counts as none.

    A negative number is neither some nor none, so it has no severity.
    """

    def some(name: str) -> Column:
        return F.coalesce(F.col(name) > 0, F.lit(False))

    def none(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == 0)

    return (
        F.when(some(dead) & some(injured), 1)
        .when(some(dead) & none(injured), 2)
        .when(none(dead) & some(injured), 3)
        .when(none(dead) & none(injured), 4)
    )


def keyword_class(
    text: Column,
    keywords: Sequence[tuple[str, str]] = rules.KEYWORD_RULES,
    default: str = rules.UNKNOWN,
) -> Column:
    """Label of the last keyword, in rule order, that the text contains.

    Matching is case-sensitive; missing text and text without a keyword get the default.
    """
    chain = None
    for keyword, label in reversed(keywords):
        found = text.contains(keyword)
        chain = F.when(found, label) if chain is None else chain.when(found, label)
    return F.lit(default) if chain is None else chain.otherwise(default)


def level_order(value: Column, levels: Sequence[str]) -> Column:
    """Position of a value in a closed, ordered domain, from 1; NULL outside it."""
    position = F.array_position(F.array(*[F.lit(level) for level in levels]), value)
    return F.nullif(position, F.lit(0)).cast("int")


def level_label(order: Column, labels: Sequence[str]) -> Column:
    """Label at a position that ``level_order`` gave."""
    return F.get(F.array(*[F.lit(label) for label in labels]), order - 1)
