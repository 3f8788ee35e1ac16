"""Classification operators: each adds a class column to an incident table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vigie import rules
from vigie.functions import classes


def classify_location(df: DataFrame) -> DataFrame:
    return df.withColumn("location", classes.location_class())


def classify_type(df: DataFrame) -> DataFrame:
    return df.withColumn("type", classes.type_class())


def classify_deadly(df: DataFrame) -> DataFrame:
    return ordered_category(
        df.withColumn("deadly", classes.deadly_class()), "deadly", ("Not deadly", "Deadly")
    )


def classify_severity(df: DataFrame, lang: str = "en") -> DataFrame:
    """Adds the severity id, its label in the chosen language and its order."""
    return label_severity(df.withColumn("id_severity", classes.severity_id()), "id_severity", lang)


def label_severity(df: DataFrame, id_column: str, lang: str = "en") -> DataFrame:
    """Adds ``severity`` and ``severity_order`` from an id column."""
    labels = [rules.translate(label, lang) for label in rules.SEVERITY_LABELS]
    return df.withColumns({
        "severity": classes.level_label(F.col(id_column), labels),
        "severity_order": F.col(id_column),
    })


def classify_by_keywords(
    df: DataFrame,
    column: str,
    keywords: Sequence[tuple[str, str]] = rules.KEYWORD_RULES,
    default: str = rules.UNKNOWN,
    output: str = "corps",
) -> DataFrame:
    """Adds the group that the last matching keyword stands for."""
    return df.withColumn(output, classes.keyword_class(F.col(column), keywords, default))


def ordered_category(
    df: DataFrame,
    column: str,
    levels: Sequence[str],
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Recode a column to its display labels and add ``<column>_order``.

    A value outside the levels becomes NULL, label and order alike.
    """
    labels = levels if labels is None else labels
    if len(labels) != len(levels):
        raise ValueError("levels and labels differ in length")
    order = f"{column}_order"
    return df.withColumn(order, classes.level_order(F.col(column), levels)).withColumn(
        column, classes.level_label(F.col(order), labels)
    )


def victim_category(df: DataFrame) -> DataFrame:
    """The victim categories in their order."""
    levels, labels = zip(*rules.VICTIM_LEVELS)
    return ordered_category(df, "categorie", levels, labels)


def display_category(df: DataFrame, column: str = "category") -> DataFrame:
    """Stored incident classes to their display labels, in display order."""
    levels, labels = zip(*rules.CATEGORY_LEVELS)
    return ordered_category(df, column, levels, labels)
