"""Source audit against plain counting and SQL; prefix levels against counting whole terms."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import edges
from compare import connect, difference
from vigie.llm import divergence
from vigie.llm.queries import ORACLE_SQL, QUERIES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top):
    """Rows are (text, lang, source)."""
    rows = [(TERM.findall((text or "").translate(LOWER)), lang or "", source or "") for text, lang, source in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for terms, lang, source in rows:
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {lang for _, lang, _ in rows}:
        kept = [term for term, n in docs[lang].items() if n >= min_docs]
        groups = sorted(source for one, source in counts if one == lang)
        share = lambda count: {
            t: 1 + 10**9 * (count[t] + 5) // (sum(count[x] for x in kept) + 5 * len(kept)) for t in kept}
        own = {source: share(counts[lang, source]) for source in groups}
        whole = share(sum((counts[lang, source] for source in groups), Counter()))
        for source in groups:
            pairs = [(sum(abs(own[source][t] - own[other][t]) for t in kept), other) for other in groups if other != source]
            terms = [(own[source][t] - whole[t], t) for t in kept if counts[lang, source][t] and own[source][t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda item: (-item[0], item[1].encode()))
                out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(items[:most], 1)]
    return sorted(out)


def found_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    name = "op11_source_divergence"
    assert difference(spark, connect(sf_dir), QUERIES[name], ORACLE_SQL[name], sf_dir) is None


@pytest.mark.parametrize("first_level", (1, 2, 5))
def test_prefix_levels(spark, first_level):
    """Terms of many lengths that share prefixes, in documents that hold several of them at once."""
    rng = random.Random(first_level)
    stems = ["a", "ab", "abc", "abcd", "abcdefgh", "abcdefghi", "abcdefgh" * 5, "é", "éa", "日本語日本語", "zz", "z" * 33]
    rows = []
    for i in range(300):
        words = [rng.choice(stems) + rng.choice(["", "", "x", "xy", str(rng.randint(0, 400)) * 3, f"q{chr(97 + rng.randint(0, 25))}"])
                 for _ in range(rng.randint(0, 15))]
        rows.append((" ".join(words).title(), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3"])))
    docs = spark.createDataFrame(rows, "text STRING, lang STRING, source STRING")
    assert found_rows(divergence.audit(docs, min_docs=7, top=5, first_level=first_level)) == plain(rows, 7, 5)
    kept = divergence.common_terms(divergence.term_rows(docs, first_level=first_level), 7, first_level).collect()
    wanted = Counter((lang or "", term) for text, lang, _ in rows for term in set(TERM.findall(text.translate(LOWER))))
    assert sorted((r.lang, bytes(r.term).decode()) for r in kept) == sorted(key for key, n in wanted.items() if n >= 7)


def test_rare_terms_are_dropped_by_their_prefix(spark, monkeypatch):
    """A long tail of rare terms under a rare prefix is counted at the first level only."""
    rows = [(f"common qq{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 9}" if i < 20 else "common", "en", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "text STRING, lang STRING, source STRING")
    levels, keep = [], divergence.stored

    def noted(df, name):
        found = keep(df, name)
        if name == "prefixes":
            levels.append({bytes(r.prefix) for r in found.collect()})
        return found

    monkeypatch.setattr(divergence, "stored", noted)
    kept = divergence.common_terms(keep(divergence.term_rows(docs), "terms"), 30).collect()
    assert [bytes(r.term) for r in kept] == [b"common"]
    assert levels == [{b"co"}, {b"comm"}, {b"common"}]


def test_edges(spark):
    docs = edges.documents(spark)
    rows = [(text, None, source) for _, text, source in edges.TEXTS]
    for min_docs in (1, 2):
        assert found_rows(divergence.audit(docs, min_docs=min_docs, top=3)) == plain(rows, min_docs, 3)
    none = divergence.audit(docs, min_docs=1000)
    groups = {source or "" for _, _, source in edges.TEXTS}
    assert {(r.source, r.item, r.value) for r in none.collect()} == {(a, b, 0) for a in groups for b in groups if a != b}
    assert divergence.audit(edges.empty(spark)).count() == 0
    clash = docs.withColumns({"term": docs.source, "prefix": docs.source, "item": docs.source})
    assert clash.count() == docs.count() and found_rows(divergence.audit(clash, min_docs=2)) == found_rows(divergence.audit(docs, min_docs=2))


def test_shares_stay_exact_for_large_counts(spark):
    count, total, terms = 9_000_000_000_000_000, 9_100_000_000_000_000, 123
    row = spark.createDataFrame([(count, total, terms)], "a BIGINT, b BIGINT, c BIGINT")
    value = row.select(divergence._share(row.a, row.b, row.c)).first()[0]
    assert value == 1 + 10**9 * (count + 5) // (total + 5 * terms)


def test_one_hot_group(spark):
    """One source with a third of all rows, one term in every document, pairs summed in several tasks."""
    rng = random.Random(2)
    rows = [("the " + " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=6)), "en", "hot" if i % 3 else f"s{i % 40}") for i in range(900)]
    docs = spark.createDataFrame(rows, "text STRING, lang STRING, source STRING").repartition(7)
    assert found_rows(divergence.audit(docs)) == plain(rows, 30, 50)


def test_counts_handed_on_in_parts(spark, monkeypatch):
    """A task that adds up few terms at a time gives the same sums."""
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    rows = [(f"one two three {chr(97 + i % 9)}b", "en", f"s{i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "text STRING, lang STRING, source STRING")
    assert divergence.term_rows(docs).count() > 60
    assert found_rows(divergence.audit(docs, min_docs=10)) == plain(rows, 10, 50)


def shared_one_by_one(rows, first_level):
    """Documents and occurrences per group, term and ``shared``; rows are (lang, source, text)."""
    wanted = Counter()
    for lang, source, text in rows:
        found, before = Counter(term.encode() for term in TERM.findall((text or "").translate(LOWER))), b""
        for term in sorted(found):
            shared, level = 0, first_level
            while min(len(term), len(before)) >= level and term[:level] == before[:level]:
                shared, level = level, 2 * level
            wanted[lang, source, term, shared, "docs"] += 1
            wanted[lang, source, term, shared, "n"] += found[term]
            before = term
    return wanted


@pytest.mark.parametrize("first_level", (1, 2, 3))
def test_terms_of_documents_counted_together(monkeypatch, first_level):
    """Documents of a batch are counted at once, with the rows that each by itself gives."""
    rng = random.Random(first_level)
    pieces = ["a", "B", "ab", "abcd", "é", "É", "日本", " ", " ", ".", "7", "\n", "\x7f", "@", "[", "`", "{"]
    rows = [(rng.choice(["en", ""]), rng.choice(["s", "t", "ü"]), "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for _ in range(900)]
    rows += [("en", "s", None), ("en", "s", ""), ("en", "s", "..."), ("fr", "only", " "), ("en", "t", "x" * 5000), ("en", "t", "x" * 4999 + " x")]
    whole = pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*rows)], ["lang", "source", "text"])
    calls, counted = [], divergence._counted
    monkeypatch.setattr(divergence, "_counted", lambda texts, *more: calls.append(len(texts)) or counted(texts, *more))
    batches = [whole.slice(0, 0), whole.slice(0, 300), whole.slice(300)]
    for held_bytes in (divergence.HELD_BYTES, 1000):
        monkeypatch.setattr(divergence, "HELD_BYTES", held_bytes)
        got, parts = Counter(), 0
        for batch in divergence._term_rows(first_level)(iter(batches)):
            parts += 1
            for row in batch.to_pylist():
                got[row["lang"], row["source"], row["term"], row["shared"], "docs"] += row["docs"]
                got[row["lang"], row["source"], row["term"], row["shared"], "n"] += row["n"]
        assert got == shared_one_by_one(rows, first_level)
        assert parts == (2 if held_bytes == 1000 else 1)
    assert calls == [300, len(rows) - 300] * 2
    assert not list(divergence._term_rows(first_level)(iter([whole.slice(0, 0)])))
