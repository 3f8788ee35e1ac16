"""Hard negatives against comparing everything, and the lists' bounds against plain products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from vigie.llm import hard_negatives
from vigie.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, score DOUBLE, number STRING, anchor STRING, place STRING, whole STRING"
SF_DIR = "/root/testdata/sf0.001"


def plain(rows, anchor):
    """Rows are (vec_id, vector, label)."""
    held = []
    for number, vector, label in rows:
        if number is None or vector is None or label is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        held.append((number, [int(np.floor(256 * float(np.float32(x)))) for x in vector], label))
    dot = lambda a, b: max(-hard_negatives.MOST, min(hard_negatives.MOST, sum(x * y for x, y in zip(a, b))))
    out = []
    for number, vector, label in held:
        if not anchor(number):
            continue
        scored = sorted((-dot(vector, other), n, kind) for n, other, kind in held if n != number)
        near = [(n, -s) for s, n, kind in scored if kind == label][:5]
        for positive, score in near:
            window = [(n, -s) for s, n, kind in scored if kind != label and 80 * score <= -100 * s <= 100 * score][:5]
            out += [(number, positive, rank, n, score, s) for rank, (n, s) in enumerate(window, 1)]
    return sorted(out)


def found_rows(df):
    return sorted(tuple(r)[:6] for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*row, None, "x", "x", "x", "x") for row in rows], SCHEMA)


def every_tenth(number):
    return number % 10 == 0


@pytest.mark.parametrize("sf", ("sf0.001", "sf0.01"))
def test_query_equals_sql(spark, sf):
    sf_dir, name = f"/root/testdata/{sf}", "op13_hard_negatives"
    assert difference(spark, connect(sf_dir), QUERIES[name], ORACLE_SQL[name], sf_dir) is None


def test_clusters_with_uneven_lengths(spark, monkeypatch):
    """Close and far rows of several blocks, lengths from 0.01 to 100, several passes of queries."""
    monkeypatch.setattr(hard_negatives, "QUERY_ROWS", 7)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(400):
        vector = (centres[i % 6] + 0.5 * rng.normal(size=24)) * 10.0 ** rng.uniform(-2, 2 if i % 50 == 0 else 0)
        rows.append((i, [float(np.float32(x)) for x in vector], int(i // 3 % 4)))
    found = hard_negatives.mine(table(spark, rows).repartition(3), anchors=F.col("vec_id") % 10 == 0)
    assert found_rows(found) == plain(rows, every_tenth)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.4], 2), (2, [0.5, 0.4], 2), (3, [0.5, 0.5], 2), (4, None, 1), (5, [0.1, None], 1),
        (6, [nan, 0.1], 2), (7, [inf, 0.1], 2), (None, [0.5, 0.5], 2), (8, [0.5, 0.5], None), (10, [0.0, 0.0], 1), (20, [], 3),
        (30, [-0.5, -0.5], 5), (31, [0.5, 0.5], 5), (32, [-0.1, -0.1], 6), (40, [0.4, 0.5, 0.1], 1), (41, [0.45], 2), (50, [0.5, 0.5], 1),
        (50, [0.5, 0.5], 1), (60, [1e25, 1.0], 7), (61, [1e25, 2.0], 7), (62, [1e25, 0.0], 8),
    ]
    docs = table(spark, rows)
    found = hard_negatives.mine(docs, anchors=F.col("vec_id") % 10 == 0)
    assert found.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found_rows(found) == plain(rows, every_tenth)
    assert hard_negatives.mine(docs.limit(0), anchors=F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(docs, anchors=F.col("vec_id") < 0).count() == 0


def test_ties_and_copies(spark):
    """A third of all rows are copies of one vector; ties go to the smaller number, in every block."""
    rng = np.random.default_rng(9)
    one = [float(np.float32(x)) for x in rng.normal(size=16)]
    rows = [(i, one if i % 3 == 0 else [float(np.float32(x)) for x in rng.normal(size=16)], int(rng.integers(3))) for i in range(600)]
    assert found_rows(hard_negatives.mine(table(spark, rows).repartition(4), anchors=F.col("vec_id") % 30 == 0)) == plain(rows, lambda n: n % 30 == 0)


@pytest.mark.parametrize("seed", range(4))
def test_lists_equal_plain_products(seed):
    """Whatever is left out or dropped, a query gets just the rows that reach its threshold."""
    rng = np.random.default_rng(seed)
    width = (64, 30, 8, 3)[seed]
    scale = 1 / (1 + np.arange(width)[::-1])
    rows = np.floor(256 * rng.normal(size=(500, width)) * scale)
    queries = np.floor(256 * rng.normal(size=(20, width)) * scale)
    products = queries @ rows.T
    omitted = 0
    for share in (0.001, 0.02, 0.3, 1.0):
        least = np.quantile(products, 1 - share, axis=1)
        index = hard_negatives.ListIndex(rows, queries, least)
        omitted += int((index.omitted > 0).sum())
        for q in range(len(queries)):
            places, scores = index.reaching(q)
            wanted = np.flatnonzero(products[q] >= least[q])
            assert sorted(places.tolist()) == wanted.tolist()
            assert (scores == products[q][places]).all()
    assert omitted or width <= 8


def test_rows_are_dropped_by_their_bounds(monkeypatch):
    """High thresholds leave few rows to be added up to the end."""
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(2000, 64)) / (1 + np.arange(64)[::-1]))
    queries = rows[:5]
    least = (queries * queries).sum(axis=1) * 0.95
    index = hard_negatives.ListIndex(rows, queries, least)
    assert index.held[0] < index.held[-1] <= 2000 and (index.omitted > 0).mean() > 0.5
    for q in range(5):
        assert q in index.reaching(q)[0].tolist()
