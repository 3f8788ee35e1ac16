"""Benchmark passages in training text. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigie.session import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# In texts as they are, capitals included: before a word that follows something that is no word.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD_START = f"(?<=[{SEPARATORS}])(?=[^{SEPARATORS}])"
WINDOW = 10
# Window-item pairs in one broadcast, at most; a longer list is searched in several passes.
BROADCAST_PAIRS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """Normalised words: A-Z in lower case, runs of a-z, 0-9 and characters beyond ASCII."""
    lower = F.translate(F.col(text), UPPER, LOWER)
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _pairwise(hashes: Column, others: Column, offset: int) -> Column:
    """Hash of each value with the one ``offset`` further on in ``others``, without incomplete ones."""
    count = F.size(others) - offset
    heads = F.slice(hashes, F.lit(1), F.greatest(count, F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, F.get(others, i + offset)))


def _with_window_hashes(rows: DataFrame, widths: list[int]) -> DataFrame:
    """Adds ``w<width>``, the hashes of all windows of that many ``words``, by doubling.

    A width is put together from its powers of two, so each costs a pass or two, not ``width``.
    """
    rows = rows.withColumn("d1", F.transform("words", lambda word: F.xxhash64(word)))
    power = 1
    while 2 * power <= max(widths):
        rows = rows.withColumn(f"d{2 * power}", _pairwise(F.col(f"d{power}"), F.col(f"d{power}"), power))
        power *= 2
    for width in widths:
        parts = [1 << bit for bit in reversed(range(width.bit_length())) if width >> bit & 1]
        name, length = f"d{parts[0]}", parts[0]
        for part in parts[1:]:
            rows = rows.withColumn(f"w{width}", _pairwise(F.col(name), F.col(f"d{part}"), length))
            name, length = f"w{width}", length + part
        if len(parts) == 1:
            rows = rows.withColumn(f"w{width}", F.col(name))
    return rows


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``gram`` (words), ``width`` and the sorted keys of ``items``.

    An item of fewer words than a window is one window, one without words has none.
    """
    words = items.select(F.col(key).cast("string").alias("item"), words_of(text).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return (
        words.filter(F.size("words") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("gram"))
        .groupBy("gram")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("width", F.size("gram"))
    )


def scan(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """Per document row: ``n_words``, hit ``spans`` (start, width) and keys of the ``items`` found.

    The windows' hashes are broadcast as a hash set; documents are read once, each word position
    looks its hash up, and a hit counts only if the words are equal. The list is counted first:
    beyond ``broadcast_pairs`` it is cut by hash into as many passes as keep each broadcast below
    that size, so documents are never shuffled. After the scan one row per document, and those
    with hits, are left to group.

    Rows are told apart by key and text, so equal rows come out as often as they went in. Null
    texts have no words. Items of null key hit words but are in no list. Without items, or with
    none that has words, nothing is hit.
    """
    windows = stored(item_windows(items, item_key, item_text, window), "windows")
    size = windows.agg(
        F.coalesce(F.sum(F.size("items") + 1), F.lit(0)), F.sort_array(F.collect_set("width"))).first()
    widths = size[1] or [window]
    passes = max(1, -(-size[0] // broadcast_pairs))
    hashed = _with_window_hashes(windows.withColumnRenamed("gram", "words"), widths)
    own = reduce(lambda other, w: F.when(F.col("width") == w, F.get(F.col(f"w{w}"), F.lit(0))).otherwise(other),
                 widths, F.lit(None).cast("long"))
    lookup = hashed.select(own.alias("hash"), F.col("words").alias("gram"), "items", "width")

    base = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), words_of(text).alias("words"))
    base = _with_window_hashes(base, widths).select(
        "key", "text_hash", "words", F.size("words").alias("n_words"),
        F.concat(*[F.col(f"w{w}") for w in widths]).alias("hashes"),
    )
    exploded = base.select("key", "text_hash", "n_words", "words", F.posexplode_outer("hashes").alias("pos", "hash"))
    # The hashes of all widths follow each other: find the width and the start of a position.
    start, width, before = F.col("pos"), F.lit(widths[-1]), F.lit(0)
    starts, kinds = [], []
    for w in widths:
        here = F.greatest(F.col("n_words") - (w - 1), F.lit(0))
        starts.append((w, before, before + here))
        before = before + here
    for w, first, end in reversed(starts):
        start = F.when(F.col("pos") < end, F.col("pos") - first).otherwise(start)
        width = F.when(F.col("pos") < end, F.lit(w)).otherwise(width)
    found = []
    for n in range(passes):
        part = lookup if passes == 1 else lookup.filter(F.pmod("hash", F.lit(passes)) == n)
        part = F.broadcast(part.withColumnRenamed("hash", "_hash"))
        hits = exploded.join(
            part,
            (F.col("hash") == F.col("_hash")) & (F.col("width") == width)
            & (F.slice("words", start + 1, F.col("width")) == F.col("gram")),
            "left",
        )
        first = F.lit(n == 0) & (F.col("pos").isNull() | (F.col("pos") == 0))
        found.append(
            hits.select(
                "key", "text_hash", "n_words", first.alias("first"),
                F.when(F.col("gram").isNotNull(), F.struct(start.alias("start"), F.col("width").alias("width"))).alias("span"),
                "items",
            ).filter("first or span is not null")
        )
    grouped = reduce(DataFrame.unionByName, found).groupBy("key", "text_hash", "n_words").agg(
        F.count_if("first").alias("rows"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return grouped.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).select(
        F.col("key").alias(key), "text_hash", F.col("n_words").cast("long"), "spans", "items")


def hit_words(spans: str = "spans") -> Column:
    """How many word positions the sorted spans cover."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda seen, span: F.struct(
            (seen["n"] + F.greatest(
                F.lit(0), span["start"] + span["width"] - F.greatest(seen["end"], span["start"]))).cast("long").alias("n"),
            F.greatest(seen["end"], span["start"] + span["width"]).alias("end"),
        ),
        lambda seen: seen["n"],
    )


def remove_contamination(
    docs: DataFrame, items: DataFrame, mode: str = "documents", key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``docs`` without the documents that hold a test window, or (``spans``) without the words hit.

    Removed words go with what follows them up to the next word; the rest of the text stays as it
    is. Other rows and columns are untouched; null keys and null texts stay.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans, not {mode!r}")
    found = scan(docs.select(key, text), items, key, text, item_key, item_text, window).filter(F.size("spans") > 0)
    found = stored(
        found.select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
        .dropDuplicates(["_key", "_hash"]),
        "contaminated",
    )
    same = docs[key].eqNullSafe(F.col("_key")) & (F.xxhash64(docs[text]) == F.col("_hash"))
    if mode == "documents":
        return docs.join(found, same, "left_anti")
    pieces = F.split(docs[text], WORD_START)
    # A text that does not begin with a word has one piece more than words.
    lead = F.when(docs[text].rlike(f"^[^{SEPARATORS}]"), 0).otherwise(1)
    covered = F.array_distinct(F.flatten(F.transform(
        "_spans", lambda span: F.sequence(span["start"], span["start"] + span["width"] - 1))))
    kept = F.filter(pieces, lambda piece, i: ~F.array_contains(covered, i - lead))
    cleaned = F.when(F.col("_spans").isNull(), docs[text]).otherwise(F.array_join(kept, ""))
    joined = docs.join(found, same, "left")
    return joined.select(*[cleaned.alias(c) if c == text else docs[c] for c in docs.columns])
