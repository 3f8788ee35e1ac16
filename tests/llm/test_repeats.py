"""Long repeats against a dictionary of all strings, and the index against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

import edges
from vigie.llm import repeats
from vigie.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain(rows, length):
    texts = [(text or "").encode() for _, text in rows]
    count = {}
    for data in texts:
        for i in range(len(data) - length + 1):
            count[data[i:i + length]] = count.get(data[i:i + length], 0) + 1
    out = []
    for (key, _), data in zip(rows, texts):
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if count[data[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_query_equals_dictionary(spark):
    wanted = plain(edges.given_rows(SF_DIR, "documents", "doc_id", "text"), 200)
    assert found_rows(QUERIES["op6_suffix_array_dedup"](spark, SF_DIR)) == wanted
    assert any(row[2] for row in wanted) and any(not row[2] for row in wanted)


def test_edges(spark):
    docs = edges.documents(spark)
    found = repeats.cut_repeats(docs)
    rows = [(k, t) for k, t, _ in edges.TEXTS if t is None or len(t) < 10_000]
    small = docs.filter("text is null or length(text) < 10000")
    assert found_rows(repeats.cut_repeats(small)) == plain(rows, 200)
    assert found.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    long = {r.doc_id: r for r in found.collect()}[9]
    assert long.n_removed == long.n_bytes == 120_000 and long.text == ""
    assert repeats.cut_repeats(edges.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_shared_passages(spark, seed):
    """Copies, edited copies, shared passages, a passage in many texts, periodic texts."""
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    passages = [fresh(n) for n in (40, 199, 200, 201, 260, 700)]
    texts = [fresh(rng.randint(0, 400)) + rng.choice(passages) + fresh(rng.randint(0, 300)) for _ in range(40)]
    texts += [fresh(5) + passages[4] + fresh(7) for _ in range(60)] + [passages[5]] * 3
    base = fresh(1500)
    for _ in range(12):
        at = rng.randint(0, 1400)
        texts.append(base[:at] + fresh(rng.randint(0, 9)) + base[at + rng.randint(0, 9):])
    texts += ["xy" * 300, "xy" * 150, "yx" * 100, "z" * 199, "z" * 200, "q" * 201, "pq" * 1200 + "r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    assert found_rows(repeats.cut_repeats(docs)) == plain(list(enumerate(texts)), 200)


def test_index_equals_plain_sorting():
    rng = np.random.default_rng(5)
    for alphabet, n in ((2, 300), (4, 500), (250, 200)):
        symbols = rng.integers(1, alphabet + 1, n).astype(np.int16)
        symbols = np.concatenate([symbols, [0], symbols[: n // 2], [0], np.ones(40, np.int16), [0]]).astype(np.int16)
        order = sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        assert repeats.suffix_order(symbols).tolist() == order
        texts = symbols.tolist()
        wanted = []
        for i in range(len(texts)):
            best = 0
            for j in range(len(texts)):
                if i != j:
                    k = 0
                    while max(i, j) + k < len(texts) and texts[i + k] == texts[j + k]:
                        k += 1
                    best = max(best, k)
            wanted.append(best)
        index = repeats.RunIndex(symbols)
        assert index.matching_statistics().tolist() == wanted
        assert len(index.run_starts) < len(symbols)


def test_long_text_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 30_000).astype(np.uint8).tobytes()
    whole = [(int(a), int(n), int(h)) for x in repeats.segments(data) for a, n, h, _ in zip(*x)]
    assert sum(n for _, n, _ in whole) == len(data) - 199
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    blocks = [(int(a), int(n), int(h)) for x in repeats.segments(data) for a, n, h, _ in zip(*x)]
    hashes = lambda rows: np.concatenate([[h] * n for _, n, h in rows])
    assert (hashes(whole) == hashes(blocks)).all()


def test_copies_are_fetched_once(spark):
    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(600))
    docs = spark.createDataFrame([(text,)] * 50 + [(text + "!",)], "text STRING").repartition(5)
    contents = docs.select(*repeats._keys("text")).distinct().selectExpr(
        "key", "check", "1L smallest", "key content", "100L first", "30 starts", "2L n")
    found = repeats.fetched(docs, contents, "text", 200).collect()
    assert len(found) == contents.count() == 2 and {bytes(r.piece) for r in found} == {text[100:329].encode()}


def test_hashes_above_the_index_are_counted(spark, monkeypatch):
    """A passage in many texts, some of them copies: no index holds more than its share, and none is missed."""
    rng = random.Random(4)
    fresh = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    passage, near = fresh(420), fresh(3)
    texts = [fresh(rng.randint(100, 300)) + passage + fresh(rng.randint(100, 300)) for _ in range(60)]
    texts += [fresh(250) + near + passage for _ in range(20)] + texts[:3] + [fresh(500), "xy" * 300, "q" * 900, "q" * 201 + fresh(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    monkeypatch.setattr(repeats, "INDEX_BYTES", 4000)
    counted = repeats.counted_starts
    large = []

    def noted(pieces, length):
        large.extend(pieces.groupBy("smallest").agg({"piece": "count"}).collect())
        return counted(pieces, length)

    monkeypatch.setattr(repeats, "counted_starts", noted)
    assert found_rows(repeats.cut_repeats(docs)) == plain(list(enumerate(texts)), 200)
    assert large and max(r[1] for r in large) > 40


def test_no_suffix_is_compared_with_itself(monkeypatch):
    """Neighbours only, and no further than the wanted length asks for; the marks stay exact."""
    rng = np.random.default_rng(8)
    base = rng.integers(1, 5, 3000).astype(np.int16)
    symbols = np.concatenate([base, [0], base[:2500], [0], np.ones(900, np.int16), [0]]).astype(np.int16)
    common, most = repeats._common, []

    def noted(packed, left, right, enough):
        assert (left != right).all()
        found = common(packed, left, right, enough)
        most.append(int((found - enough).max()))
        return found

    monkeypatch.setattr(repeats, "_common", noted)
    index = repeats.RunIndex(symbols)
    exact = index.matching_statistics()
    most.clear()
    for limit in (1, 20, 200, 2400):
        limited = index.matching_statistics(limit)
        assert ((limited >= limit) == (exact >= limit)).all()
        assert (limited[exact < limit] == exact[exact < limit]).all()
    assert max(most) <= 7
