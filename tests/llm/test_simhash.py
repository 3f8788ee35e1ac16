"""Fingerprints and components against a plain computation over all pairs."""

import re

import numpy as np
import pytest
import xxhash

import edges
from vigie.llm import simhash
from vigie.llm.queries import QUERIES
from vigie.llm.tables import components

SF_DIR = "/root/testdata/sf0.001"


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def plain_components(rows):
    prints = [plain_print(text) for _, text in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[max(top(i), top(j))] = min(top(i), top(j))
    roots = [top(i) for i in range(len(rows))]
    out = []
    for (key, _), value, root in zip(rows, prints, roots):
        keys = [k for (k, _), r in zip(rows, roots) if r == root and k is not None]
        out.append((key, f"{value:016x}", min(keys) if keys else None))
    return sorted(out, key=repr), len(set(roots))


def test_query_equals_all_pairs(spark):
    found = [tuple(row) for row in QUERIES["op8_simhash"](spark, SF_DIR).collect()]
    assert sorted(found, key=repr) == plain_components(edges.given_rows(SF_DIR, "documents", "doc_id", "text"))[0]


def test_edges(spark):
    found = simhash.near_copies(edges.documents(spark)).collect()
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found), key=repr)
    assert got == plain_components([(key, text) for key, text, _ in edges.TEXTS])[0]
    assert simhash.near_copies(edges.empty(spark)).count() == 0


@pytest.mark.parametrize("max_bits", [0, 3, 5])
def test_links_miss_no_pair(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    values = set(base)
    for value in base:
        for n in range(1, 7):
            flips = rng.choice(64, n, replace=False)
            values.add(value ^ sum(1 << int(b) for b in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp BIGINT"), max_bits).collect()}
    mask = (1 << 64) - 1
    wanted = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= max_bits}
    assert found == wanted and (max_bits == 0) == (not wanted)


def test_one_of_each_group_stays(spark):
    kept = simhash.drop_near_copies(edges.documents(spark))
    assert kept.columns == edges.documents(spark).columns
    found = kept.collect()
    classes, n = plain_components([(key, text) for key, text, _ in edges.TEXTS])
    assert len(found) == n and {row.doc_id for row in found} == {component for _, _, component in classes}
    assert simhash.drop_near_copies(edges.empty(spark)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(300)}, 4000: 4000, 5000: 4000}


def test_columns_of_any_name_stay(spark):
    docs = edges.documents(spark).withColumnsRenamed({"hash": "_print", "words": "row", "items": "_key"})
    found = simhash.drop_near_copies(docs)
    assert found.columns == docs.columns
    assert found.exceptAll(docs).isEmpty() and found.filter("_print = 'x' and row = 'x' and _key = 'x'").count() == found.count()
