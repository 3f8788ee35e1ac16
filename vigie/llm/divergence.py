"""Audit of how sources differ: common terms by prefix refinement, then exact shares per source.

A term can only be common if each of its prefixes is. So byte prefixes are counted by distinct
documents, level by level, and a term goes on only while its prefix reaches the threshold: the
long tail of rare terms is counted under few short prefixes and never shuffled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigie.session import stored

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
SCALE = 1_000_000_000
# Bytes of the first level's prefixes; each level doubles them.
FIRST_LEVEL = 2
# Documents whose terms are counted together, counts of terms and their bytes that a task adds up before it
# hands them on, and rows of one Arrow batch.
COUNTED_DOCS = 2_000
HELD_TERMS = 1_200_000
HELD_BYTES = 200 << 20
BATCH_TERMS = 100_000
# Sums of source pairs a task holds before it hands them on.
HELD_PAIRS = 2_000_000
# --- fixed values: bytes of terms, A to Z as a to z and all beyond ASCII; others end a term -----
LETTERS = np.array(
    [byte + 32 if 0x41 <= byte <= 0x5A else byte if 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20 for byte in range(256)], np.uint8
)

# What a task holds: groups go by number.
HELD = pa.schema([("group", pa.int64()), ("term", pa.binary()), ("shared", pa.int32()), ("docs", pa.int64()), ("n", pa.int64())])
TERM_ROWS = "lang string, source string, term binary, shared int, docs bigint, n bigint"


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts (of type large_string, without nulls) in their order, and the number of the text of each."""
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, "<i8")[texts.offset:texts.offset + len(texts) + 1]
    first, end = int(starts[0]), int(starts[-1])
    letters = LETTERS[np.frombuffer(data, np.uint8)[first:end]] if end > first else np.zeros(0, np.uint8)
    inside = letters != 0x20
    # A term begins after what ends one, or where its text begins; it ends before what ends it, or where one begins.
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = starts[:-1][starts[:-1] < end] - first
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    at = np.flatnonzero(begins)
    # Without what lies between them terms follow one another.
    places = np.append(0, np.cumsum(np.flatnonzero(ends) - at + 1)).astype("<i8")
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(letters[inside])])
    return terms, np.searchsorted(starts, at + first, "right") - 1


def _shared(terms: pa.Array, before: np.ndarray, after: np.ndarray, first_level: int) -> np.ndarray:
    """How many leading bytes terms, given by two places each in the sorted ``terms``, have in common, cut to a level."""
    sizes, shared, level = pc.binary_length(terms).to_numpy(), np.zeros(len(after), np.int32), first_level
    while True:
        long = np.flatnonzero(sizes >= level)
        prefixes = pc.binary_slice(terms.take(pa.array(long)), 0, level)
        same = pc.equal(prefixes[1:], prefixes[:-1]).to_numpy(zero_copy_only=False) if len(long) else np.zeros(0, bool)
        if not same.any():
            return shared
        # Terms of one prefix are neighbours: they have one number, all others their own.
        starts = np.ones(len(sizes), bool)
        starts[long[1:][same]] = False
        number = np.cumsum(starts)
        shared[number[before] == number[after]] = level
        level *= 2


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct key, how often it occurs and the sums of its values."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[starts], np.diff(np.append(starts, len(keys))), *(np.add.reduceat(value[order], starts) for value in values)


def _counted(texts: pa.Array, groups: np.ndarray, first_level: int) -> pa.Table:
    """Per group, ``shared`` and term the documents and occurrences of texts, whose groups are given by number."""
    terms, text = _terms(texts)
    if not len(terms):
        return HELD.empty_table()
    coded = terms.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    distinct, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    # Each document's terms in byte order, and how often it holds them.
    held, counts = np.unique(text * len(order) + place[coded.indices.to_numpy()], return_counts=True)
    text, place = np.divmod(held, len(order))
    shared = np.zeros(len(held), np.int32)
    next_ = np.flatnonzero(text[1:] == text[:-1]) + 1
    shared[next_] = _shared(distinct, place[next_ - 1], place[next_], first_level)
    levels, level = np.unique(shared, return_inverse=True)
    keys, docs, n = _summed((groups[text] * len(levels) + level) * len(order) + place, counts)
    key, place = np.divmod(keys, len(order))
    group, level = np.divmod(key, len(levels))
    columns = [group, distinct.take(pa.array(place)).cast(pa.binary()), levels[level], docs, n]
    return pa.Table.from_arrays([pa.array(column, field.type) for column, field in zip(columns, HELD)], schema=HELD)


def _term_rows(first_level: int):
    """Adds up, per group, ``shared`` and term, the documents and occurrences of some documents at a time."""
    def merged(held: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(held).group_by(["group", "term", "shared"], use_threads=False).aggregate(
            [("docs", "sum"), ("n", "sum")])
        return found.rename_columns(HELD.names).select(HELD.names)

    def batches_of(table: pa.Table, names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array(one, pa.string()) for one in zip(*names))
        for batch in table.to_batches(max_chunksize=BATCH_TERMS):
            yield pa.RecordBatch.from_pydict({
                "lang": langs.take(batch["group"]), "source": sources.take(batch["group"]),
                **{name: batch[name] for name in ("term", "shared", "docs", "n")},
            })

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def full() -> float:
            """What is held, as a share of what may be."""
            terms, size = sum(table.num_rows for table in held), sum(table.nbytes for table in held)
            return max(max(terms, len(numbers)) / HELD_TERMS, size / HELD_BYTES)

        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED_DOCS):
                langs, sources, texts = batch.slice(at, COUNTED_DOCS).columns
                groups = [numbers.setdefault(one, len(numbers)) for one in zip(langs.to_pylist(), sources.to_pylist())]
                held.append(_counted(pc.fill_null(texts, "").cast(pa.large_string()), np.array(groups, np.int64), first_level))
                if full() > 1:
                    held = [merged(held)]
                    # Where little room is left, further documents would soon fill it again.
                    if full() > 0.5:
                        yield from batches_of(held[0], list(numbers))
                        held, numbers = [], {}
        if held:
            yield from batches_of(merged(held), list(numbers))

    return rows


def term_rows(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", first_level: int = FIRST_LEVEL
) -> DataFrame:
    """Terms of documents in counts: rows of group, term (its bytes) and ``shared``, added up per task.

    ``shared`` is how many leading bytes a term has in common with the document's term before it in byte
    order, cut to a level (0, ``first_level``, twice that, ...). A document's first term under any prefix
    of L bytes is the one that shares fewer than L, so adding up the ``docs`` of those rows counts
    distinct documents, without their ids. ``n`` adds up the occurrences.
    """
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    return docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.col(text).alias("text")).mapInArrow(
        _term_rows(first_level), TERM_ROWS)


def _leading(size: int) -> Column:
    return F.substring("term", 1, size)


def common_terms(rows: DataFrame, min_docs: int = MIN_DOCS, first_level: int = FIRST_LEVEL) -> DataFrame:
    """``lang`` and ``term`` of the terms that at least ``min_docs`` documents of the language hold.

    Per level: prefixes are counted by documents, terms that end within the level are complete and
    kept or dropped, longer ones go on if their prefix reaches the threshold. The surviving
    prefixes are stored and joined; Spark broadcasts them while they are below its threshold and
    shuffles beyond it. Levels end when no prefix survives: their number grows with the logarithm of
    the longest common term.
    """
    added = lambda rows: F.sum(F.when(rows, F.col("docs")).otherwise(0))
    kept, below, level = [], None, first_level
    while True:
        going = rows.select("lang", "term", "shared", "docs")
        if below is not None:
            going = going.filter(F.length("term") > level // 2).join(
                below, (F.col("lang") == F.col("_lang")) & (_leading(level // 2) == F.col("_prefix")), "left_semi")
        ends = F.length("term") <= level
        counted = stored(
            going.groupBy("lang", _leading(level).alias("prefix"))
            .agg(added(F.col("shared") < level).alias("docs"), added(ends).alias("whole"), added(~ends).alias("longer"))
            .filter(F.col("docs") >= min_docs),
            "prefixes",
        )
        kept.append(counted.filter(F.col("whole") >= min_docs).select("lang", F.col("prefix").alias("term")))
        below = counted.filter(F.col("longer") >= min_docs).select(F.col("lang").alias("_lang"), F.col("prefix").alias("_prefix"))
        if below.isEmpty():
            break
        level *= 2
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return found


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exact for any counts."""
    upper = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(19,0)")
    lower = (total + SMOOTHING * terms).cast("decimal(19,0)")
    return F.when(terms > 0, F.call_function("div", upper, lower) + 1)


class Shares:
    """The kept terms with their counts per group and per language."""

    def __init__(self, docs: DataFrame, text: str, lang: str, source: str, min_docs: int, first_level: int):
        rows = stored(term_rows(docs, text, lang, source, first_level), "terms")
        self.terms = stored(common_terms(rows, min_docs, first_level), "kept")
        kept = self.terms.select(F.col("lang").alias("_lang"), F.col("term").alias("_term"))
        same = (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term"))
        #: Occurrences of each kept term in the groups that have it.
        self.counts = stored(
            # Terms meet by hash and stay where they are for the sums; no side is sorted or sent everywhere.
            rows.join(kept.hint("shuffle_hash"), same, "left_semi").groupBy("lang", "source", "term").agg(
                F.sum("n").alias("count")),
            "counts",
        )
        blank = lambda name: F.coalesce(F.col(name), F.lit(""))
        groups = docs.select(blank(lang).alias("lang"), blank(source).alias("source")).distinct()
        totals = self.counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        sizes = self.terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
        #: Every group with the occurrences of all its kept terms and the number of terms of its language.
        self.groups = stored(
            groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
            .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")),
            "groups",
        )

    def top_terms(self, top: int) -> DataFrame:
        """Per group the terms whose share is above the language's, by how much; the first ``top``."""
        whole = self.counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"))
        totals = self.groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        rows = self.counts.join(whole, ["lang", "term"]).join(self.groups, ["lang", "source"]).join(totals, "lang")
        excess = _share(F.col("count"), F.col("total"), F.col("terms")) - _share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
        by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("term"))
        return (
            rows.select("lang", "source", "term", excess.alias("value")).filter("value > 0")
            .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
            .select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), "value", "rank")
        )

    def pairs(self) -> DataFrame:
        """Per group and other group of the language the summed differences of their shares.

        The groups of a language go with each of its terms; a task sums the differences of a
        batch of terms for all pairs at once, and sums of tasks are added.
        """
        sources = self.groups.groupBy("lang").agg(
            F.sort_array(F.collect_list(F.struct("source", "total", "terms"))).alias("groups"))
        sources = stored(sources.select(
            "lang", F.col("groups.source").alias("sources"),
            F.transform("groups", lambda g: _share(F.lit(0), g["total"], g["terms"])).alias("base"),
        ), "sources")
        numbers = sources.select("lang", F.posexplode("sources").alias("number", "source"))
        held = self.counts.join(self.groups, ["lang", "source"]).join(numbers, ["lang", "source"]).select(
            "lang", "term", F.struct("number", _share(F.col("count"), F.col("total"), F.col("terms")).alias("share")).alias("held"))
        present = held.groupBy("lang", "term").agg(F.collect_list("held").alias("held")).join(
            sources.select("lang", "base"), "lang")
        sums = present.select("lang", "base", F.col("held.number").alias("at"), F.col("held.share").alias("shares")).mapInPandas(
            _differences, "lang string, a int, b int, value bigint")
        value = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        ends = sources.select("lang", F.posexplode("sources").alias("a", "source"), "sources").select(
            "lang", "a", "source", F.posexplode("sources").alias("b", "item")).filter("a <> b")
        full = ends.join(value, ["lang", "a", "b"], "left").select(
            "lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
        by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
        return full.select(
            "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))


def _differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of |share of a - share of b| over terms, for all ordered pairs of a language's groups."""
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pd.DataFrame]:
        for lang, sums in held.items():
            a, b = np.nonzero(sums)
            for at in range(0, len(a), 100_000):
                part = slice(at, at + 100_000)
                yield pd.DataFrame({"lang": lang, "a": a[part].astype(np.int32), "b": b[part].astype(np.int32), "value": sums[a[part], b[part]]})
        held.clear()

    for batch in batches:
        for lang, terms in batch.groupby("lang", sort=False):
            base = np.asarray(terms["base"].iloc[0], np.int64)
            # As many terms at once as keep the matrix of shares small.
            step = max(1, HELD_PAIRS // len(base))
            if lang not in held:
                if held and sum(s.size for s in held.values()) + len(base) ** 2 > HELD_PAIRS:
                    yield from rows()
                held[lang] = np.zeros((len(base), len(base)), np.int64)
            sums = held[lang]
            for at in range(0, len(terms), step):
                part = terms.iloc[at:at + step]
                shares = np.repeat(base[None, :], len(part), axis=0)
                for row, own, values in zip(shares, part["at"], part["shares"]):
                    row[own] = values
                for a in range(len(base)):
                    sums[a] += np.abs(shares - shares[:, a:a + 1]).sum(axis=0)
    yield from rows()


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS, first_level: int = FIRST_LEVEL,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how far sources lie apart, and on which terms.

    Terms are runs of letters A to Z in lower case and of characters beyond ASCII; those that at least
    ``min_docs`` documents of a language hold are kept. Each group of language and source, and each
    language, gives every kept term a smoothed share in whole billionths. ``pair`` rows sum, per
    other source of the language, the differences of all shares; ``term`` rows are the first ``top``
    terms of a group whose share is above the language's. Null texts, languages and sources count
    as empty; every row is a document, repeated ones too. A group without terms has the smoothed
    shares of none; without any kept term pairs have 0; no rows give no rows.
    """
    shares = Shares(docs.select(text, lang, source), text, lang, source, min_docs, first_level)
    return shares.pairs().unionByName(shares.top_terms(top)).withColumn("rank", F.col("rank").cast("int"))
