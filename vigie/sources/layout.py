"""Incident rows and places stored side by side, so that locating them shuffles nothing.

For place tables too large to broadcast that are joined again and again. Rows and places are written
in buckets of the same key, once; every later join reads bucket by bucket. A place with more rows
than a bucket should hold is dealt over several keys, and its place is repeated under each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigie import rules
from vigie.operators.prepare import apply_place_overrides
from vigie.rules import PlaceOverride

KEY = "place_key"
# Rows of one bucket, about: the number of buckets and what counts as a hot place follow from it.
BUCKET_ROWS = 2_000_000


def _key(place: Column, salt: Column) -> Column:
    """Text for an id and a salt; a missing id has a text, too, and both zeros have one."""
    text = F.coalesce((place + F.lit(0.0)).cast("string"), F.lit("none"))
    return F.concat(text, F.lit("#"), salt.cast("string"))


def _salts(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """The places with more rows than a bucket should hold, and over how many keys they go."""
    return (
        rows.groupBy(F.col("id").alias("_hot"))
        .agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("_salts"))
        .filter("_salts > 1")
    )


def _write(df: DataFrame, table: str, path: str | None, buckets: int) -> None:
    writer = df.repartition(buckets, KEY).write.mode("errorifexists").bucketBy(buckets, KEY).sortBy(KEY)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def store_by_place(
    rows: DataFrame,
    localites: DataFrame,
    name: str,
    folder: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> None:
    """Writes tables ``<name>_rows`` and ``<name>_places``, both in buckets of ``place_key``.

    ``rows`` are what ``prepare.point_rows`` or ``line_rows`` give. The tables go to the warehouse, or
    to ``folder``. As many buckets are made as there are ``bucket_rows`` in the rows.
    """
    same = F.col("id").eqNullSafe(F.col("_hot"))
    hot = _salts(rows, bucket_rows)
    several = F.coalesce("_salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*rows.columns), several)
    keyed = rows.join(hot, same, "left").withColumn(KEY, _key(F.col("id"), salt)).drop("_hot", "_salts")
    places = (
        localites.join(hot, same, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), several - 1)))
        .withColumn(KEY, _key(F.col("id"), F.col("_salt")))
        .drop("_hot", "_salts", "_salt", "id")
    )
    buckets = max(1, -(-rows.count() // bucket_rows))
    for df, part in ((keyed, "rows"), (places, "places")):
        _write(df, f"{name}_{part}", folder and f"{folder.rstrip('/')}/{part}", buckets)


def locate_stored(
    spark: SparkSession,
    name: str,
    overrides: Sequence[PlaceOverride] = rules.PLACE_OVERRIDES,
) -> DataFrame:
    """The rows of ``store_by_place`` with their places' attributes, as ``prepare.locate_points`` gives them.

    Keys are equal where ids are, and never missing, so buckets meet without an exchange.
    """
    joined = spark.table(f"{name}_rows").join(spark.table(f"{name}_places"), KEY, "left")
    return apply_place_overrides(joined.drop(KEY), overrides)
