"""Hard negatives by threshold joins over inverted lists that leave out what bounds can answer.

All rows lie in blocks. A block's index holds, per dimension, the rows and their components, but a
row's leading dimensions are left out as long as the norms of these parts of the row and of the
queries cannot reach the lowest threshold. Partial scores are added up from the last dimension to the
first; a row is dropped for a query as soon as its score so far and the norms of what remains stay
below the query's threshold. Thresholds begin high and fall for the queries that have not found
enough, so the answer is that of comparing everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigie.session import stored

POSITIVES = 5
NEGATIVES = 5
CLASSES = 10
SCALE = 256
# Rows indexed together, and queries that are asked together.
BLOCK_ROWS = 4_096
QUERY_ROWS = 4_096
# Dimensions added up between two looks at the bounds.
STRIDE = 8
# Thresholds of positives: the length of the query times that of the longest row, made smaller each
# round; after so many rounds the queries still short are asked for all rows.
FALL = 0.75
ROUNDS = 12
# Thresholds of negatives, as parts of the way from the positive's score to the window's lower end.
WINDOW_PARTS = (0.25, 0.5, 0.75, 1.0)
# From this size on, a sum of products may not be exact in doubles.
EXACT = float(1 << 53)
MOST = (1 << 63) - 1


class ListIndex:
    """The inverted lists of one block of rows.

    Dimensions come in a given order, those of little weight first. ``omitted`` is a row's number of
    leading dimensions left out; rows are sorted by it, so the list of a dimension is a prefix of
    the rows.
    """

    def __init__(self, rows: np.ndarray, queries: np.ndarray, thresholds: np.ndarray):
        n, width = rows.shape
        self.steps = list(range(0, width, STRIDE)) + [width]
        norms = _leading_norms(rows, self.steps)
        asking = _leading_norms(queries, self.steps)
        # A part of a row is left out while it cannot reach any query's threshold by itself.
        omitted = np.zeros(n, np.int64)
        if len(queries) and thresholds.min() > 0:
            for i in range(1, len(self.steps)):
                with np.errstate(divide="ignore"):
                    reach = np.min(thresholds / asking[:, i])
                omitted[(omitted == i - 1) & (norms[:, i] * (1 + 1e-9) + 1e-9 < reach)] = i
        self.order = np.argsort(omitted, kind="stable")
        self.rows, self.norms, self.omitted = rows[self.order], norms[self.order], omitted[self.order]
        #: Rows in the lists of each stride of dimensions.
        self.held = [int(np.searchsorted(self.omitted, i, "right")) for i in range(len(self.steps) - 1)]
        self.queries, self.asking, self.thresholds = queries, asking, thresholds

    def reaching(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the block that reach the query's threshold, and their exact scores."""
        x, lengths, least = self.queries[q], self.asking[q], self.thresholds[q]
        most = lengths[-1] * (self.norms[:, -1].max() if len(self.norms) else 0.0)
        slack = 1e-6 * (most + 1)
        inside, sums = np.arange(self.held[-1] if most + slack >= least else 0), None
        for i in range(len(self.steps) - 2, -1, -1):
            if not len(inside):
                break
            first, last = self.steps[i], self.steps[i + 1]
            if sums is None:
                sums = np.zeros(len(inside))
            # Rows whose dimensions of this stride are listed: a prefix of those still in question.
            listed = int(np.searchsorted(inside, self.held[i]))
            some = slice(0, listed) if len(inside) == self.held[-1] else inside[:listed]
            sums[:listed] += self.rows[some, first:last] @ x[first:last]
            # What a row may still gain: the dimensions before this stride, or those left out.
            left = np.maximum(i, self.omitted[inside])
            going = sums + self.norms[inside, left] * lengths[left] + slack >= least
            if not going.all():
                inside, sums = inside[going], sums[going]
        scores = self.rows[inside] @ x
        if most >= EXACT:
            scores = np.array([_exact(row, x) for row in self.rows[inside]], object)
        whole = np.flatnonzero(scores >= least)
        return self.order[inside[whole]], scores[whole]


def _exact(row: np.ndarray, x: np.ndarray) -> int:
    """A score of any size, brought to the range of a long."""
    return max(-MOST, min(MOST, sum(int(a) * int(b) for a, b in zip(row, x))))


def _leading_norms(rows: np.ndarray, steps: list[int]) -> np.ndarray:
    """The length of each row's first dimensions, up to each step."""
    squares = np.cumsum(rows * rows, axis=1)
    return np.sqrt(np.hstack([np.zeros((len(rows), 1)), squares[:, [s - 1 for s in steps[1:]]]]))


def taking_part(vector: str) -> Column:
    """Vectors that are not null and whose components are all there and finite."""
    parts = F.col(vector).cast("array<double>")
    return F.coalesce(F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def prepared(rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """``number``, ``label`` and ``whole`` (components times ``scale``, rounded down) of the rows that take part."""
    return rows.filter(taking_part(vector) & F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).cast("long").alias("number"), F.col(label).cast("long").alias("label"),
        F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("whole"),
    )


def dimension_order(rows: DataFrame) -> np.ndarray:
    """Dimensions by the sum of their squares, the smallest first; one number per dimension reaches the driver."""
    sums = (
        rows.select(F.posexplode("whole").alias("dimension", "x")).groupBy("dimension")
        .agg(F.sum(F.col("x") * F.col("x")).alias("weight")).orderBy("weight", "dimension").collect()
    )
    return np.array([row.dimension for row in sums], np.int64)


def _matrix(vectors, order: np.ndarray) -> np.ndarray:
    """Rows in the order of dimensions; a shorter vector ends in zeros."""
    out = np.zeros((len(vectors), len(order)))
    for row, vector in zip(out, vectors):
        row[:len(vector)] = vector
    return out[:, order]


class Queries:
    """Queries of one pass: bounded in number, so that they may travel with the tasks."""

    def __init__(self, rows: list, order: np.ndarray):
        self.rows, self.order = rows, order
        self.matrix = _matrix([row.whole for row in rows], order)


Pick = Callable[[int, np.ndarray, np.ndarray, np.ndarray], list[tuple]]


def scan(rows: DataFrame, queries: Queries, thresholds: np.ndarray, pick: Pick, schema: str) -> DataFrame:
    """What ``pick`` keeps, per query and block, of the rows that reach the query's threshold.

    ``pick`` gets a query's place, and numbers, labels and scores of its rows, highest scores first.
    """
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[at:at + BLOCK_ROWS]
                numbers, labels = part["number"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
                index = ListIndex(_matrix(part["whole"], queries.order), queries.matrix, thresholds)
                out: list[tuple] = []
                for q in range(len(thresholds)):
                    places, scores = index.reaching(q)
                    if len(places):
                        # By score, the highest first, and by number.
                        by = np.argsort(numbers[places], kind="stable")
                        by = by[np.argsort(-scores[by], kind="stable")]
                        out += pick(q, numbers[places[by]], labels[places[by]], scores[by])
                if out:
                    yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(look, schema)


def _passes(asked: DataFrame, size: int = QUERY_ROWS) -> Iterator[list]:
    """Stored queries in parts of about ``size`` by a hash: what travels with a pass is bounded."""
    parts = max(1, -(-asked.count() // size))
    for i in range(parts):
        some = asked.filter(F.pmod(F.xxhash64("anchor"), F.lit(parts)) == i).orderBy("anchor").collect()
        if some:
            yield some


def _joined(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def positives(rows: DataFrame, anchors: DataFrame, order: np.ndarray, n: int = POSITIVES) -> DataFrame:
    """The first ``n`` other rows of each anchor's label: ``anchor``, ``place`` (from 1), ``number``, ``score``.

    A round finds all rows above its threshold, so anchors with ``n`` of them are done; the others
    go on with a lower one. The last round asks for all rows.
    """
    squares = F.aggregate("whole", F.lit(0.0), lambda total, x: total + x * x)
    longest = float(np.sqrt(rows.agg(F.max(squares)).first()[0] or 0.0))
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("number"))
    done, open_ = [], anchors
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS
        answers = []
        for some in _passes(open_):
            queries = Queries(some, order)
            reach = np.sqrt((queries.matrix * queries.matrix).sum(axis=1)) * longest * FALL ** (turn + 1)
            if last:
                reach = np.full(len(some), -np.inf)
            answers.append(scan(rows, queries, reach, _of_own_label(some, n), "anchor long, number long, score long"))
        if not answers:
            break
        reached = stored(
            _joined(answers).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n), "reached")
        full = reached.filter(F.col("place") == n).select(F.col("anchor").alias("_anchor"))
        same = F.col("anchor") == F.col("_anchor")
        done.append(reached if last else reached.join(full, same, "left_semi"))
        open_ = stored(open_.join(full, same, "left_anti"), "open")
    columns = ("anchor", "place", "number", "score")
    return _joined(done).select(*columns) if done else rows.sparkSession.createDataFrame(
        [], "anchor long, place int, number long, score long")


def _of_own_label(some: list, n: int) -> Pick:
    names, own, labels = ([getattr(row, name) for row in some] for name in ("anchor", "number", "label"))

    def pick(q: int, numbers: np.ndarray, kinds: np.ndarray, scores: np.ndarray) -> list[tuple]:
        kept = np.flatnonzero((kinds == labels[q]) & (numbers != own[q]))[:n]
        return [(names[q], int(numbers[i]), int(scores[i])) for i in kept]

    return pick


def negatives(rows: DataFrame, anchors: DataFrame, windows: DataFrame, order: np.ndarray, n: int = NEGATIVES,
              low: int = 80, high: int = 100) -> DataFrame:
    """The first ``n`` rows of another label in each window: ``anchor``, ``place``, ``number``, ``score``.

    ``windows`` holds anchor, place and the positive's score. A row is in the window if ``low`` times
    that score is at most 100 times its own, and ``high`` times that at least. A window is done when
    it has ``n`` rows above the threshold of its round, which at last is its own lower end.
    """
    best = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("number"))
    done, open_ = [], windows
    for part in WINDOW_PARTS:
        places = open_.groupBy(F.col("anchor").alias("_anchor")).agg(F.collect_list(F.struct("place", "score")).alias("windows"))
        asked = stored(anchors.join(places, F.col("anchor") == F.col("_anchor")).drop("_anchor"), "asked")
        answers = []
        for some in _passes(asked):
            # The lowest threshold of the anchor's windows; all of them get what is above it.
            upper = np.array([min(window.score for window in row.windows) for row in some], float) * (high / 100)
            lower = np.array([min(window.score for window in row.windows) for row in some], float) * (low / 100)
            least = np.floor(np.minimum(upper + (lower - upper) * part, upper))
            answers.append(scan(
                rows, Queries(some, order), least, _of_other_label(some, n, low, high),
                "anchor long, place int, number long, score long"))
        if not answers:
            break
        reached = stored(
            _joined(answers).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n), "reached")
        full = reached.filter(F.col("rank") == n).select(F.col("anchor").alias("_anchor"), F.col("place").alias("_place"))
        same = (F.col("anchor") == F.col("_anchor")) & (F.col("place") == F.col("_place"))
        done.append(reached if part == WINDOW_PARTS[-1] else reached.join(full, same, "left_semi"))
        open_ = stored(open_.join(full, same, "left_anti"), "open")
    columns = ("anchor", "place", "rank", "number", "score")
    return _joined(done).select(*columns) if done else rows.sparkSession.createDataFrame(
        [], "anchor long, place int, rank int, number long, score long")


def _of_other_label(some: list, n: int, low: int, high: int) -> Pick:
    names, own, labels = ([getattr(row, name) for row in some] for name in ("anchor", "number", "label"))
    windows = [[(window.place, window.score) for window in row.windows] for row in some]

    def pick(q: int, numbers: np.ndarray, kinds: np.ndarray, scores: np.ndarray) -> list[tuple]:
        other = np.flatnonzero((kinds != labels[q]) & (numbers != own[q]))
        values = [int(score) for score in scores[other]]
        out = []
        for place, score in windows[q]:
            kept = 0
            for i, value in zip(other, values):
                if 100 * value < low * score or kept == n:
                    break
                if 100 * value <= high * score:
                    out.append((names[q], place, int(numbers[i]), value))
                    kept += 1
        return out

    return pick


def mine(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", anchors: Column | None = None,
    n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = 80, high: int = 100, scale: int = SCALE,
) -> DataFrame:
    """Per anchor and positive the first negatives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, scores.

    Anchors are the rows for which ``anchors`` holds (all by default). Scores are inner products of
    the components times ``scale``, rounded down. An anchor's positives are its first ``n_positives``
    other rows of the same label; its negatives for one of them are the first rows of another label
    that score from ``low`` to ``high`` percent of it. Higher scores come first, ties by smaller key.
    Rows of null key, label or vector, or with null or non-finite components take no part; a
    shorter vector ends in zeros. Repeated rows are rows of their own, though a row never answers an
    anchor of its own key. A score beyond a long is brought to its range. An anchor without other rows of
    its label, and a positive without rows in its window (one of negative score, for one), give none.
    """
    held = stored(prepared(rows, key, vector, label, scale), "vectors")
    chosen = F.lit(True) if anchors is None else anchors
    taken = rows.filter(chosen)
    asking = stored(
        prepared(taken, key, vector, label, scale).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    order = dimension_order(held)
    near = stored(positives(held, asking, order, n_positives), "positives")
    found = negatives(held, asking, near.select("anchor", "place", "score"), order, n_negatives, low, high)
    names = asking.select(F.col("anchor").alias("_anchor"), F.col("number").alias("anchor_id"))
    known = near.select(
        F.col("anchor").alias("_near"), F.col("place").alias("_place"), F.col("number").alias("positive_id"),
        F.col("score").alias("positive_score"))
    return (
        found.join(known, (F.col("anchor") == F.col("_near")) & (F.col("place") == F.col("_place")))
        .join(names, F.col("anchor") == F.col("_anchor"))
        .select("anchor_id", "positive_id", "rank", F.col("number").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"), F.col("place").alias("positive_rank"))
    )
