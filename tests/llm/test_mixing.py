"""Targets against a plain water level, and what the mix takes against its bounds."""

import math
import re

import pytest

import edges
from vigie.llm import mixing
from vigie.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def plain_targets(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        stopped = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not stopped:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in stopped:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= stopped
    return sizes, target


def check(found, rows):
    sizes, target = plain_targets(rows)
    taken = {}
    for row in found:
        assert row.source_size == sizes[row.source]
        assert math.isclose(row.target, target[row.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= row.taken <= 3 * row.size
        taken[row.source] = taken.get(row.source, 0) + row.taken
    for source, total in taken.items():
        assert abs(total - target[source]) <= 1, (source, total, target[source])
    plain = sorted((key, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))) for key, text, _ in rows if key is not None)
    assert sorted((r.doc_id, r.size) for r in found if r.doc_id is not None) == plain


def test_query_meets_targets(spark):
    rows = edges.given_rows(SF_DIR, "documents", "doc_id", "text", "source")
    found = QUERIES["op10_mixing"](spark, SF_DIR).collect()
    check(found, rows)
    again = QUERIES["op10_mixing"](spark, SF_DIR).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_edges(spark):
    check(mixing.mix(edges.documents(spark)).collect(), edges.TEXTS)
    assert mixing.mix(edges.empty(spark)).count() == 0


def test_uneven_sources_and_stopped_targets(spark):
    texts = [(i, "w " * (i % 50 + 1), "big") for i in range(400)]
    texts += [(1000 + i, "w " * 7, "middle") for i in range(30)] + [(2000, "w w w", "small"), (2001, "w", None)]
    texts += [(3000 + i, None, "nothing") for i in range(3)]
    check(mixing.mix(edges.documents(spark, texts)).collect(), texts)


def test_rates_are_exponential_in_size(spark):
    """The rates solve the dual: their logarithm is a line through the origin in size, below the bound."""
    texts = [(i, "w " * (i % 40 + 1), f"s{i % 3}") for i in range(300)]
    for source in ("s0", "s1", "s2"):
        slopes = {
            round(math.log(r.rate) / r.size, 9)
            for r in mixing.mix(edges.documents(spark, texts)).filter(f"source = '{source}' and rate < 3").collect()
        }
        assert max(slopes) - min(slopes) < 1e-6


def test_main_path_is_native(spark):
    plan = QUERIES["op10_mixing"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n", [1, 2])
def test_one_document(spark, n):
    texts = [(i, "one two three", "only") for i in range(n)]
    check(mixing.mix(edges.documents(spark, texts)).collect(), texts)
