"""Long repeats across documents, marked with a run-length compressed Burrows-Wheeler transform.

A string of ``length`` bytes that starts in two places has the same smallest hash of its
``GRAM``-byte pieces in both. So the starts of each text are cut into runs of equal smallest
hash (segments), and only segments that share that hash are indexed together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from vigie.session import stored

LENGTH = 200
GRAM = 64
# Starts of one segment, at most; a longer run of one hash is cut, which loses nothing.
SEGMENT_STARTS = 400
# Text worked on at once, in bytes.
BLOCK = 1 << 20
# Bytes of segments in one index, about; the segments of a hash that has more are not indexed.
INDEX_BYTES = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _piece_hashes(block: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte pieces."""
    hashes, factor, span = block.astype(np.uint64) + np.uint64(1), FACTOR, 1
    while 2 * span <= GRAM:
        hashes = hashes[:-span] + factor * hashes[span:]
        factor, span = factor * factor, span * 2
    if span < GRAM:  # two overlapping halves
        rest = GRAM - span
        hashes = hashes[:-rest] + factor * hashes[rest:]
    hashes ^= hashes >> np.uint64(32)
    hashes *= MIX
    hashes ^= hashes >> np.uint64(29)
    return hashes


def _smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each start, the smallest of the next ``width`` hashes."""
    span = 1
    while 2 * span <= width:
        hashes = np.minimum(hashes[:-span], hashes[span:])
        span *= 2
    return np.minimum(hashes[:len(hashes) - (width - span)], hashes[width - span:]) if width > span else hashes


def _returning(hashes: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which segments may repeat themselves: those whose smallest hash is back within their starts.

    Hashes are looked up by their low bits first; a false alarm only costs indexing.
    """
    seen = np.zeros(1 << 20, bool)
    low = np.uint64((1 << 20) - 1)
    seen[values & low] = True
    at = np.flatnonzero(seen[hashes & low])
    found = hashes[at]
    by = np.lexsort((at, found))
    at, found = at[by], found[by]
    gaps = np.where(found[1:] == found[:-1], at[1:] - at[:-1], len(hashes))
    near = np.flatnonzero(gaps < sizes.max())
    if not len(near):
        return np.zeros(len(values), bool)
    names, group = np.unique(found[near], return_inverse=True)
    smallest = np.full(len(names), len(hashes))
    np.minimum.at(smallest, group.ravel(), gaps[near])
    place = np.minimum(np.searchsorted(names, values), len(names) - 1)
    return (names[place] == values) & (smallest[place] < sizes)


def segments(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of one text, block by block: first start, number of starts, smallest hash, whether
    it may repeat itself."""
    width = length - GRAM + 1
    total = len(data) - length + 1
    array = np.frombuffer(data, np.uint8)
    for at in range(0, total, BLOCK):
        end = min(at + BLOCK, total)
        with np.errstate(over="ignore"):
            hashes = _piece_hashes(array[at:end + length - 1])
        smallest = _smallest(hashes, width)
        heads = np.flatnonzero(np.concatenate([[True], smallest[1:] != smallest[:-1]]))
        sizes = np.diff(np.append(heads, end - at))
        if sizes.max() > SEGMENT_STARTS:
            pieces = -(-sizes // SEGMENT_STARTS)
            order = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cut = np.repeat(heads, pieces) + order * SEGMENT_STARTS
            sizes = np.minimum(np.repeat(heads + sizes, pieces) - cut, SEGMENT_STARTS)
            heads = cut
        values = smallest[heads]
        returning = _returning(hashes, values, sizes)
        yield heads + at, sizes, values.view(np.int64), returning


def _segment_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for key, check, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = _bytes(text)
                for first, sizes, smallest, returning in segments(data, length):
                    contents = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in
                                zip(first.tolist(), (first + sizes + (length - 1)).tolist())]
                    held.append((key, check, first, sizes, smallest, np.array(contents, np.uint64).view(np.int64), returning))
                    n += len(first)
                if n > 200_000:
                    yield _joined(held)
                    held, n = [], 0
            if held:
                yield _joined(held)

    return rows


def _joined(held: list[tuple]) -> pa.RecordBatch:
    counts = [len(row[2]) for row in held]
    return pa.RecordBatch.from_pydict({
        "key": pa.array(np.repeat([row[0] for row in held], counts), pa.int64()),
        "check": pa.array(np.repeat([row[1] for row in held], counts), pa.int32()),
        "first": pa.array(np.concatenate([row[2] for row in held]), pa.int64()),
        "starts": pa.array(np.concatenate([row[3] for row in held]), pa.int32()),
        "smallest": pa.array(np.concatenate([row[4] for row in held]), pa.int64()),
        "content": pa.array(np.concatenate([row[5] for row in held]), pa.int64()),
        "returning": pa.array(np.concatenate([row[6] for row in held]), pa.bool_()),
    })


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling the compared length of those not yet told apart."""
    n = len(symbols)
    key = _packed_symbols(symbols)
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = head + 1
    rank[n] = 0
    single = fresh & np.append(fresh[1:], True)
    open_ = order[~single]
    compared = 7
    while len(open_):
        key = (rank[open_] << 32) | rank[np.minimum(open_ + compared, n)]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        group = key >> 32
        at = np.arange(len(open_))
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        row = group - 1 + at - group_start
        order[row] = open_
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(fresh, row, 0))
        rank[open_] = head + 1
        single = fresh & np.append(fresh[1:], True)
        open_ = open_[~single]
        compared *= 2
    return order


def _packed_symbols(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols of nine bits from each position, zeros beyond the end."""
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(len(symbols), np.int64)
    for i in range(7):
        key = (key << 9) | padded[i:i + len(symbols)]
    return key


def _common(packed: np.ndarray, left: np.ndarray, right: np.ndarray, enough: np.ndarray) -> np.ndarray:
    """Length of the common start of pairs of different suffixes, seven symbols at a time.

    A pair is left alone once it has ``enough`` symbols in common: its length is then that or more.
    """
    n, length, going = len(packed), np.zeros(len(left), np.int64), np.arange(len(left))
    a, b = left, right
    while len(going):
        differ = packed[a] ^ packed[b]
        equal = sum((differ < 1 << 63 - 9 * m).astype(np.int64) for m in range(1, 7)) + (differ == 0)
        length[going] += equal
        a, b = a + 7, b + 7
        on = (differ == 0) & (a < n) & (b < n) & (length[going] < enough[going])
        going, a, b = going[on], a[on], b[on]
    return np.minimum(length, n - np.maximum(left, right))


class RunIndex:
    """The Burrows-Wheeler transform in runs, with the suffix positions at both ends of each run."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_order(symbols)
        last = np.where(order > 0, symbols[order - 1].astype(np.int64), -1)
        changes = last[1:] != last[:-1]
        heads = np.flatnonzero(np.concatenate([[True], changes]))
        tails = np.append(heads[1:] - 1, len(order) - 1)
        self.symbols, self.run_symbols, self.run_starts = symbols, last[heads], heads
        self.packed = _packed_symbols(symbols)
        self.head_at, self.tail_at = order[heads], order[tails]
        # The neighbours across the run ends: all that the matching statistics need.
        self.above = order[np.maximum(heads - 1, 0)]
        self.below = order[np.minimum(tails + 1, len(order) - 1)]

    def _streamed(self, at: np.ndarray, other: np.ndarray, outside: int, limit: int) -> np.ndarray:
        """Match lengths with the neighbouring suffix of every position, from those at run ends.

        Inside a run the neighbours of a position and of the one before move together, so the
        length falls by one with each step until the next sampled position; a sampled pair is
        compared until that leaves ``limit``. The suffix at ``outside`` has no neighbour.
        """
        by = np.argsort(at)
        sampled_at = at[by]
        enough = np.empty(len(at), np.int64)
        enough[by] = np.diff(np.append(sampled_at, len(self.symbols))) + limit
        length = np.zeros(len(at), np.int64)
        pairs = np.delete(np.arange(len(at)), outside)
        length[pairs] = _common(self.packed, at[pairs], other[pairs], enough[pairs])
        length = length[by]
        position = np.arange(len(self.symbols))
        sampled = np.zeros(len(position), np.int64)
        sampled[sampled_at] = np.arange(len(at))
        sampled = np.maximum.accumulate(sampled)
        return length[sampled] - (position - sampled_at[sampled])

    def matching_statistics(self, limit: int | None = None) -> np.ndarray:
        """For every position the longest string from there that also starts elsewhere.

        With a ``limit``, lengths are exact below it; from there on they only say that it is reached.
        """
        limit = len(self.symbols) if limit is None else limit
        above = self._streamed(self.head_at, self.above, 0, limit)
        below = self._streamed(self.tail_at, self.below, len(self.tail_at) - 1, limit)
        return np.maximum(above, below)


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, whether the string of ``length`` bytes at each start is in another place, too."""
    parts = []
    for piece in pieces:
        parts += [np.frombuffer(piece, np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]
    symbols = np.concatenate(parts)
    found = RunIndex(symbols).matching_statistics(length) >= length
    out, at = [], 0
    for piece in pieces:
        out.append(found[at:at + len(piece) - length + 1])
        at += len(piece) + 1
    return out


def _runs(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the marked starts."""
    starts = np.flatnonzero(flags)
    if not len(starts):
        return []
    apart = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, apart + 1)].tolist(), (starts[np.append(apart, len(starts) - 1)] + length).tolist()))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


SPANS = "array<struct<a:bigint,b:bigint>>"


def _keys(text: str) -> list[Column]:
    """96 bits that stand for a text, null and empty alike."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("key"), F.hash(F.lit(1), whole).alias("check")]


def _packed(text: str) -> Column:
    """The compressed UTF-8 bytes of a text: what is shuffled instead of it."""

    @F.pandas_udf("binary")
    def values(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in texts:
            yield pd.Series([pack(_bytes(text)) for text in batch], dtype=object)

    return values(text)


def fetched(docs: DataFrame, contents: DataFrame, text: str, length: int) -> DataFrame:
    """The bytes of each content, once: cut from one of the rows that hold its text."""
    wanted = contents.groupBy("key", "check").agg(
        F.collect_list(F.struct("smallest", "content", "first", "starts", "n")).alias("wanted"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for packed, places in zip(batch["packed"], batch["wanted"]):
                data = unpack(packed)
                rows += [(p["smallest"], p["content"], p["n"], data[p["first"]:p["first"] + p["starts"] + length - 1])
                         for p in places]
            yield pd.DataFrame(rows, columns=["smallest", "content", "n", "piece"])

    texts = docs.select(*_keys(text), _packed(text).alias("packed")).groupBy("key", "check").agg(F.first("packed").alias("packed"))
    return (
        texts.join(wanted, ["key", "check"])
        .select("packed", "wanted")
        .mapInPandas(fetch, "smallest bigint, content bigint, n bigint, piece binary")
    )


def _start_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            smallest, content, n, pieces = (batch.column(i).to_pylist() for i in range(4))
            for at in range(0, len(pieces), 1000):
                part = pieces[at:at + 1000]
                counts = [len(piece) - length + 1 for piece in part]
                strings = [xxhash.xxh3_64_intdigest(piece[i:i + length]) for piece, m in zip(part, counts) for i in range(m)]
                repeated = lambda values: np.repeat(np.array(values[at:at + 1000], np.int64), counts)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({
                    "smallest": pa.array(repeated(smallest)), "content": pa.array(repeated(content)), "n": pa.array(repeated(n)),
                    "at": pa.array(np.concatenate([np.arange(m, dtype=np.int32) for m in counts])),
                    "string": pa.array(np.array(strings, np.uint64).view(np.int64)),
                })

    return rows


def counted_starts(pieces: DataFrame, length: int) -> DataFrame:
    """What the index finds, for any number of pieces of one hash: the string at each start is counted."""
    starts = stored(
        pieces.select("smallest", "content", "n", "piece").mapInArrow(
            _start_rows(length), "smallest bigint, content bigint, n bigint, at int, string bigint"),
        "starts",
    )
    strings = stored(
        starts.groupBy("smallest", "string").agg(F.sum("n").alias("n")).filter("n > 1").select("smallest", "string"), "strings")

    @F.pandas_udf(SPANS)
    def spans(places: pd.Series) -> pd.Series:
        runs = [_runs(np.bincount(found, minlength=1), length) for found in places]
        return pd.Series([[{"a": a, "b": b} for a, b in r] for r in runs], dtype=object)

    return (
        starts.join(strings, ["smallest", "string"])
        .groupBy(F.col("smallest").alias("_smallest"), F.col("content").alias("_content"))
        .agg(F.collect_list("at").alias("places"))
        .select("_smallest", "_content", spans("places").alias("spans"))
    )


def repeat_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per distinct text (``key``, ``check``) that has any: the byte ranges of long repeats.

    1. Segments of all texts are stored (hashes only) and counted by smallest hash; a hash seen
       once holds no repeat, unless it returns inside its segment.
    2. If all segments of a hash are equal, each is a repeat as a whole, with no index at all: so
       exact copies and the inside of common passages cost a count, however many there are.
    3. Of the other hashes one segment of each content is fetched, indexed in parts of about
       ``INDEX_BYTES`` by hash, and its matching statistics mark the starts that occur elsewhere.
       Contents that occur several times are marked whole.
    4. A hash whose segments are more than ``INDEX_BYTES`` (a very common passage with many
       surroundings) has the strings at all their starts hashed and counted instead, so its
       segments need not meet in one task.
    """
    cut = stored(
        docs.select(*_keys(text), F.col(text).alias("text")).mapInArrow(
            _segment_rows(length),
            "key bigint, check int, first bigint, starts int, smallest bigint, content bigint,"
            " returning boolean",
        ),
        "segments",
    )
    groups = (
        cut.groupBy("smallest")
        .agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"),
             F.max("returning").alias("returning"))
        .filter("n > 1 or returning")
        .select(F.col("smallest").alias("_smallest"), F.expr("low <> high or n = 1").alias("mixed"))
    )
    again = stored(cut.join(groups, cut.smallest == F.col("_smallest")).drop("_smallest", "returning"), "again")
    mixed = again.filter("mixed")
    whole = again.filter("not mixed").select(
        "key", "check", F.col("first").alias("a"), (F.col("first") + F.col("starts") + (length - 1)).alias("b"))

    place = F.struct("key", "check", "first", "starts")
    contents = stored(
        mixed.groupBy("smallest", "content")
        .agg(F.min(place).alias("place"), F.count("*").alias("n"))
        .select("smallest", "content", "n", "place.*"),
        "contents",
    )
    sizes = contents.groupBy("smallest").agg(F.sum(F.col("starts") + (length - 1)).alias("size"))
    over = F.col("size") > INDEX_BYTES
    size, n_large = sizes.agg(F.sum(F.when(~over, F.col("size"))), F.count(F.when(over, 1))).first()
    parts = max(1, -(-(size or 0) // INDEX_BYTES))
    pieces = small = fetched(docs, contents, text, length)
    if n_large:
        pieces = stored(pieces, "pieces")
        # As many hashes as there are INDEX_BYTES in all segments, at most.
        large = F.broadcast(sizes.filter(over).select("smallest"))
        small = pieces.join(large, "smallest", "left_anti")

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(list(rows["piece"]), length)
        spans = [[(0, len(piece))] if n > 1 else _runs(flags, length) for flags, n, piece in zip(found, rows["n"], rows["piece"])]
        out = pd.DataFrame({
            "_smallest": rows["smallest"].to_numpy(), "_content": rows["content"].to_numpy(),
            "spans": [[{"a": a, "b": b} for a, b in s] for s in spans],
        })
        return out[[len(s) > 0 for s in spans]]

    marks = (
        small.withColumn("part", F.pmod(F.col("smallest"), F.lit(parts)))
        .groupBy("part").applyInPandas(mark, f"_smallest bigint, _content bigint, spans {SPANS}")
    )
    if n_large:
        marks = marks.unionByName(counted_starts(pieces.join(large, "smallest", "left_semi"), length))
    marked = stored(marks, "marked")
    partial = (
        mixed.join(marked, (F.col("smallest") == F.col("_smallest")) & (F.col("content") == F.col("_content")))
        .select("key", "check", "first", F.inline("spans"))
        .select("key", "check", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    )
    return whole.unionByName(partial).groupBy("key", "check").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def cut_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the kept text in place of ``text``, and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Texts count as UTF-8 bytes, null as empty. Every byte covered by a string of ``length`` bytes
    that starts anywhere else, too, goes, in all its places; strings are judged on the texts as
    given. The digest is that of the bytes kept; in the text characters cut in two are left out. A
    null text without anything removed stays null. Repeated rows are documents of their own, and
    so repeat each other. Rows, keys and other columns stay as they are.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    others = [c for c in docs.columns if c != text and c not in names]
    spans = repeat_spans(docs.select(text), text, length)
    rows = docs.select(F.struct(*others).alias("other") if others else F.lit(None).alias("other"),
                       F.col(text).isNull().alias("absent"), *_keys(text), _packed(text).alias("packed"))
    joined = rows.join(spans, ["key", "check"], "left").select("other", "absent", "packed", "spans")

    cleaned = F.pandas_udf(_cleaned, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:string>")
    done = joined.select("other", "absent", cleaned("packed", "spans").alias("done"))
    kept = F.when(~F.col("absent"), F.col("done.kept")).alias(text)
    return done.select(
        *[kept if c == text else F.col("other").getField(c).alias(c) for c in docs.columns if c not in names],
        *[F.col(f"done.{name}") for name in names],
    )


def _cleaned(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for packed, spans in batches:
        rows = []
        for data, found in zip(packed, spans):
            data = unpack(data)
            runs = _merged([(s["a"], s["b"]) for s in found]) if found is not None else []
            kept = _kept(data, runs)
            rows.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(),
                         kept.decode("utf-8", "ignore")))
        yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


_cleaned.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
