"""Near copies by SimHash fingerprints, with candidates pruned by the pigeonring principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vigie.llm.tables import components
from vigie.session import stored

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """The majority of the bits of all shingles' hashes, as a signed number.

    A-Z become a-z, words end at ASCII white space, a text of fewer words is one shingle, a
    text without words (or null) has fingerprint zero. A tie gives a zero bit.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    width = min(words, len(parts))
    ends = (np.cumsum([len(part) + 1 for part in parts]) - 1).tolist()
    starts = [0, *(end + 1 for end in ends)]
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(line[start:end], SEED) for start, end in zip(starts, ends[width - 1:])),
        np.uint64,
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        rows = hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_of(text: str | Column, words: int = 3) -> Column:
    """The fingerprint of each text as a 64-bit number."""

    @F.pandas_udf("long")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(text, words) for text in batch], dtype="int64")

    return values(text)


def _budget(segments: int, max_bits: int) -> int:
    """Differing bits that a chain of so many segments may have."""
    return segments * max_bits // SEGMENTS


def _masks(max_bits: int) -> list[int]:
    """Differences that the first two segments of a chain may have, as 32-bit masks."""
    found = []
    for n in range(_budget(2, max_bits) + 1):
        for bits in combinations(range(2 * WIDTH), n):
            if sum(bit < WIDTH for bit in bits) <= _budget(1, max_bits):
                found.append(sum(1 << bit for bit in bits))
    return found


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct numbers in ``fp`` that differ in 1 to ``max_bits`` bits.

    The 64 bits are a ring of four segments. If two numbers differ in at most t bits, then from
    some segment on, every run of 1, 2, 3 and 4 segments differs in at most 1, 2, 3 and 4 times
    t/4 bits. One side of the join holds the first two segments of each of its four chains, the
    other side all values within the budgets of the two, so only numbers that agree in about
    32 bits meet; the two longer budgets are checked on the pair. No group is listed in pairs:
    what comes out are links, each once per chain before the final ``distinct``.
    """
    low = (1 << WIDTH) - 1
    segments = [F.shiftrightunsigned("fp", i * WIDTH).bitwiseAND(F.lit(low)) for i in range(SEGMENTS)]
    chains = prints.select(
        "fp",
        F.posexplode(F.array(*[
            segments[i] + F.shiftleft(segments[(i + 1) % SEGMENTS], WIDTH) for i in range(SEGMENTS)
        ])).alias("chain", "pair"),
    )
    left = chains.select(F.col("fp").alias("a"), "chain", "pair")
    right = chains.select(
        F.col("fp").alias("b"),
        F.col("chain").alias("_chain"),
        F.explode(F.array(*[F.lit(mask).cast("long") for mask in _masks(max_bits)])).alias("mask"),
        "pair",
    ).select("b", "_chain", F.col("pair").bitwiseXOR(F.col("mask")).alias("_pair"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    # Bits outside the fourth segment of the chain, which starts at (chain + 3) % 4.
    three = F.element_at(
        F.array(*[
            F.lit(~(low << (i + 3) % SEGMENTS * WIDTH)
                  if (i + 3) % SEGMENTS < 3 else (1 << 3 * WIDTH) - 1).cast("long")
            for i in range(SEGMENTS)
        ]),
        F.col("chain") + 1,
    )
    return (
        left.join(
            right,
            (F.col("chain") == F.col("_chain")) & (F.col("pair") == F.col("_pair"))
            & (F.col("a") < F.col("b"))
            & (F.bit_count(differing.bitwiseAND(three)) <= _budget(3, max_bits))
            & (F.bit_count(differing) <= max_bits),
        )
        .select("a", "b")
        .distinct()
    )


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 3
) -> DataFrame:
    """Per row: the key, its fingerprint ``fp`` and ``component_id``, the smallest key reachable.

    Texts are read once. Exact copies meet in one fingerprint before any candidate is sought.
    Repeated rows come out repeated. A null key is larger than any other, and a component of
    null keys alone has a null id. Empty, blank and null texts share fingerprint zero and are
    linked like any other. No rows in, no rows out.
    """
    prints = stored(
        docs.select(F.col(key).alias("key"), fingerprint_of(text, words).alias("fp")), "fingerprints"
    )
    return _members(prints, max_bits).withColumnRenamed("key", key)


def _members(prints: DataFrame, max_bits: int) -> DataFrame:
    """The rows of stored fingerprints (``key``, ``fp``) with their component."""
    distinct = stored(prints.groupBy("fp").agg(F.min("key").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(placed.join(smallest, "root").select("fp", "component_id", "root"), "classes")
    return prints.join(classes, "fp").select("key", "fp", "component_id", "root")


def drop_near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 3
) -> DataFrame:
    """The rows of ``docs`` without near copies: one of each component stays, that of smallest key.

    Texts are read once: rows are stored with their fingerprint. Rows that agree in key and
    fingerprint are told apart only where there are any.
    """
    marked = stored(
        docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), fingerprint_of(text, words).alias("fp")),
        "marked",
    )
    members = _members(marked.select("key", "fp"), max_bits)
    kept = stored(
        members.groupBy("root")
        .agg(F.min_by(F.struct(F.col("key").alias("_key"), F.col("fp").alias("_fp")),
                      F.struct(F.col("key").isNull(), F.col("key"), F.col("fp"))).alias("one"))
        .select("one.*"),
        "kept",
    )
    counts = marked.groupBy(F.col("key").alias("_key"), F.col("fp").alias("_fp")).count()
    several = stored(
        kept.join(counts.filter("count > 1"),
                  kept._key.eqNullSafe(counts._key) & (kept._fp == counts._fp), "left_semi"),
        "several",
    )

    def among(keys: DataFrame) -> DataFrame:
        return marked.join(keys, marked.key.eqNullSafe(keys._key) & (marked.fp == keys._fp), "left_semi")

    single = kept.join(several.withColumnsRenamed({"_key": "_k", "_fp": "_f"}),
                       F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_fp") == F.col("_f")), "left_anti")
    rest = among(several).dropDuplicates(["key", "fp"])
    return among(single).unionByName(rest).select("row.*")
