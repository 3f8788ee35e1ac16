"""Labels in the chosen language."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigie import rules


def localize_labels(
    df: DataFrame, column: str, dictionary: DataFrame, lang: str, output: str | None = None
) -> DataFrame:
    """Replace English labels by their text in ``lang``; unknown labels stay as they are."""
    if lang not in rules.LANGUAGES:
        raise ValueError(f"language must be one of {rules.LANGUAGES}, not {lang!r}")
    output = output or column
    if lang == "en":
        return df.withColumn(output, F.col(column))
    # One row per English text, so that a repeated entry cannot multiply rows.
    entries = dictionary.groupBy(F.col("en").alias("_label")).agg(F.min(lang).alias("_text"))
    return (
        df.join(entries, F.col(column) == F.col("_label"), "left")
        .withColumn(output, F.coalesce("_text", column))
        .drop("_label", "_text")
    )
