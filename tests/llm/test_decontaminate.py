"""Test windows in documents against a plain search."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import edges
from vigie.llm import decontaminate
from vigie.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(docs, items):
    windows = {}
    for item, text in items:
        found = words(text)
        for i in range(max(1, len(found) - 9) if found else 0):
            windows.setdefault(tuple(found[i:i + 10]), set()).add(item)
    widths = sorted({len(w) for w in windows})
    out = []
    for key, text in docs:
        found, hit, seen = words(text), set(), set()
        for width in widths:
            for i in range(len(found) - width + 1):
                for item in windows.get(tuple(found[i:i + width]), ()):
                    hit.update(range(i, i + width))
                    seen.add(item)
                if tuple(found[i:i + width]) in windows:
                    hit.update(range(i, i + width))
        names = ",".join(sorted(str(item) for item in seen if item is not None))
        n_items = len([item for item in seen if item is not None])
        out.append((key, len(found), len(hit), n_items, hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def digest(found):
    n_hit = decontaminate.hit_words()
    rows = found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("s"), (n_hit > 0).alias("c")).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_equals_plain_search(spark):
    found = sorted((tuple(r) for r in QUERIES["op2_decontamination"](spark, SF_DIR).collect()), key=repr)
    wanted = plain_scan(edges.given_rows(SF_DIR, "documents", "doc_id", "text"), edges.given_rows(SF_DIR, "benchmark", "item_id", "text"))
    assert found == wanted and any(row[-1] for row in wanted)


ITEMS = [
    (1, "one two THREE four five six seven eight nine ten eleven"), (2, "two three"), (2, "twelve"), (3, "word"),
    (4, None), (5, ""), (None, "tail"), (6, "... !!"), (7, edges.PASSAGE), (8, edges.PASSAGE), (9, "ab ab ab"),
    (10, "日本語 テキスト"), (11, "b"),
]


@pytest.mark.parametrize("pairs", [500_000, 50])
def test_edges_and_several_passes(spark, pairs):
    items = spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")
    found = decontaminate.scan(edges.documents(spark), items, broadcast_pairs=pairs)
    assert digest(found) == plain_scan([(k, t) for k, t, _ in edges.TEXTS], ITEMS)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")
    assert decontaminate.scan(edges.empty(spark), items).count() == 0
    found = digest(decontaminate.scan(edges.documents(spark), items.limit(0)))
    assert found == plain_scan([(k, t) for k, t, _ in edges.TEXTS], [])


def test_main_path_is_native(spark):
    plan = QUERIES["op2_decontamination"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_documents_or_spans_go(spark):
    items = spark.createDataFrame([(1, "b c d"), (2, "z")], "item_id BIGINT, text STRING")
    docs = spark.createDataFrame(
        [(1, "A; b, C d! e"), (2, "..b c d"), (3, "clean text"), (4, None), (None, "x Z y")], "doc_id BIGINT, text STRING")
    kept = decontaminate.remove_contamination(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]
    spans = decontaminate.remove_contamination(docs, items, "spans")
    assert {r.doc_id: r.text for r in spans.collect()} == {1: "A; e", 2: "..", 3: "clean text", 4: None, None: "x y"}
    assert decontaminate.remove_contamination(edges.documents(spark), items).columns == edges.documents(spark).columns
