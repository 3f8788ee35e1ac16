"""Exact token counts: a histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigie.session import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# --- fixed value: how this vocabulary cuts text into pieces -------------------
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# --- fixed value: what the pattern takes as white space ------------------------
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The pattern cannot be run over much longer stretches of white space.
RUN = 10_000
# Lengths whose sums are taken together first.
BLOCK = 1024


def _counter(encoding: tiktoken.Encoding, run: int) -> Callable[[str], int]:
    """Counts the tokens of a text, whose long stretches of white space are cut as the pattern cuts them.

    All of a stretch but its last character is one piece; the last one goes with what follows. At
    the end of a text a stretch is one piece.
    """
    stretches = re.compile(f"{BLANK}{{{run},}}").finditer

    def count(text: str) -> int:
        total = at = 0
        for found in stretches(text):
            end = found.end() if found.end() == len(text) else found.end() - 1
            total += len(encoding.encode_ordinary(text[at:found.start()]))
            if end > found.start():
                total += len(encoding._encode_single_piece(text[found.start():end]))
            at = end
        return total + len(encoding.encode_ordinary(text[at:]))

    return count


def token_count(text: str | Column, vocabulary: str = VOCABULARY, pieces: str = PIECES) -> Column:
    """Tokens of a whole text; null and empty have none, special tokens are ordinary text.

    The vocabulary file is read here and travels with the tasks, so executors need no copy.
    """
    with open(vocabulary, "rb") as file:
        held = file.read()
    run = RUN

    @F.pandas_udf("long")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, held.splitlines())}
        count = _counter(tiktoken.Encoding("given", pat_str=pieces, mergeable_ranks=ranks, special_tokens={}), run)
        for batch in batches:
            yield pd.Series([count(text) if text else 0 for text in batch], dtype="int64")

    return values(text)


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """Per encoded length ``n_tokens``: ``docs``, ``tokens``, and what follows for a context of that length.

    ``docs_upto`` documents fit whole, ``docs_beyond`` are longer; ``truncated_total`` is the tokens
    left when each document is cut to the length, ``share_upto`` the quantile of the length.
    Documents are summed per length before the shuffle; the sums then run per block of lengths and
    over the blocks, so no step holds more than the distinct lengths of a block. Every row counts,
    null texts as length 0; no rows give no lengths.
    """
    counts = docs.select(token_count(text, vocabulary, pieces).alias("n_tokens")).groupBy("n_tokens").agg(
        F.count("*").alias("docs"))
    # Read twice; one row per length, so that texts are encoded once.
    return suffix_sums(stored(counts, "lengths"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """The histogram ``counts`` (``n_tokens``, ``docs``) with its running sums."""
    rows = counts.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    whole = Window.partitionBy()
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).select(
        F.col("block").alias("_block"),
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("d").over(whole).alias("all_docs"),
    )
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    docs_upto = F.col("docs_before") + F.sum("docs").over(upto)
    tokens_upto = F.col("tokens_before") + F.sum("tokens").over(upto)
    return (
        rows.join(blocks, F.col("block") == F.col("_block"))
        .select("n_tokens", "docs", "tokens", docs_upto.alias("docs_upto"), tokens_upto.alias("tokens_upto"), "all_docs")
        .select(
            "n_tokens", "docs", "tokens", "docs_upto", (F.col("all_docs") - F.col("docs_upto")).alias("docs_beyond"),
            (F.col("tokens_upto") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_upto"))).alias("truncated_total"),
            (F.col("docs_upto") / F.col("all_docs")).alias("share_upto"),
        )
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: tokens left when documents are cut to it, and how many are cut."""
    n, limit = F.col("n_tokens"), F.explode(F.array(*[F.lit(x) for x in limits]))
    return histogram.select("n_tokens", "docs", limit.alias("context")).groupBy("context").agg(
        F.sum(F.least(n, F.col("context")) * F.col("docs")).alias("tokens"),
        F.sum(F.when(n > F.col("context"), F.col("docs")).otherwise(0)).alias("docs_cut"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """Per share the smallest length that so many documents do not exceed."""
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in shares]))
    return histogram.select("n_tokens", "share_upto", wanted.alias("share")).filter("share_upto >= share").groupBy(
        "share").agg(F.min("n_tokens").alias("n_tokens"))
