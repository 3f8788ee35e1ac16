"""The given tables, and components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigie.session import stored


# Bytes of rows that go to a Python worker at once: whole texts would add up to much more.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def small_batches(spark: SparkSession) -> None:
    """Has rows go to Python workers a few megabytes at a time, however long their texts are."""
    spark.conf.set(*BATCH_BYTES)


def given(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a given table, all of them without names."""
    small_batches(spark)
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return table.select(*columns) if columns else table


def components(links: DataFrame) -> DataFrame:
    """Node and ``root`` (the smallest node reachable) of every node in ``links`` (a, b).

    Stars are drawn larger and smaller in turn until nothing changes, so rounds grow with
    the logarithm of a component's length. Each round ends in a stored table; only a count
    and a checksum reach the driver. Nodes of any sortable type; no link may hold a null.
    """
    ends = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    stars = stored(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        both = stars.select(F.inline(ends))
        centre = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.filter("b > a").join(centre, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = large.distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(lowest, "a").select(
            F.inline(F.array(
                F.struct(F.col("a"), F.col("root").alias("b")),
                F.struct(F.col("b").alias("a"), F.col("root").alias("b")),
            ))
        )
        stars = stored(small.filter("a > b").distinct(), "links")
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
