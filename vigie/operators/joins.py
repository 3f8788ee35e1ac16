"""Joins whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Rows of one key that one salt holds; a key with more is dealt over several.
SALT_ROWS = 16


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equal columns, where a missing value equals a missing value."""
    return reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)))


def sized(rows: DataFrame, others: DataFrame, keys: Sequence[str], salt_rows: int = SALT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``_n``, the rows a key has in the first one if they are more than one salt's."""
    names = [f"_sized_{key}" for key in keys]
    hot = rows.groupBy(*[F.col(key).alias(name) for key, name in zip(keys, names)]).agg(
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > salt_rows)
    one, other = (table.join(hot, same_keys(keys, names), "left").drop(*names) for table in (rows, others))
    return one, other


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_rows: int = SALT_ROWS) -> DataFrame:
    """Inner join on equal ``keys``, missing ones too, where no key is too hot.

    Both sides have ``_n``, the left rows of their key, or null for few (``sized``). Equal rows of a
    side are counted first and joined as one row. The left rows of a key are then dealt over one salt
    per ``salt_rows``, in each of which the key's right rows are repeated: k left and n right rows of
    one key meet in k / ``salt_rows`` groups of ``salt_rows`` * n pairs. The result has the left columns
    and the right ones that are no keys, and rows come as often as in a plain join.
    """
    mine = [name for name in left.columns if name != "_n"]
    others = [name for name in right.columns if name not in (*keys, "_n")]
    salts = F.coalesce(F.ceil(F.col("_n") / salt_rows), F.lit(1))
    none = F.lit(0).cast("long")
    # Equal rows are cut into pieces of one salt's size, and each piece has a salt of its own.
    piece = F.explode(F.sequence(none, F.floor((F.col("_times") - 1) / salt_rows))).alias("_piece")
    dealt = (
        left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_times"))
        .select(*left.columns, "_times", piece)
        .select(
            *mine, F.least(F.lit(salt_rows), F.col("_times") - F.col("_piece") * salt_rows).alias("_times"),
            F.pmod(F.xxhash64(*mine) + F.col("_piece"), salts).alias("_salt"),
        )
    )
    repeated = (
        right.groupBy(*right.columns).agg(F.count(F.lit(1)).alias("_more"))
        .select(*[F.col(key).alias(f"_right_{key}") for key in keys], *others, "_more",
                F.explode(F.sequence(none, salts - 1)).alias("_in"))
    )
    met = dealt.join(repeated, same_keys([*keys, "_salt"], [*(f"_right_{key}" for key in keys), "_in"]))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times") * F.col("_more"))).alias("_time")
    return met.select(*mine, *others, times).drop("_time")
