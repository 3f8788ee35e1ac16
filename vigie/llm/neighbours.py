"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigie.session import stored

# Vectors of one shard, about, and queries that search a shard together.
SHARD_ROWS = 16_384
QUERY_ROWS = 2_048
LINKS = 16
BEAM_BUILD = 64
BEAM_SEARCH = 160
SHRINK = 16
NONE = -1


def usable(vector: str) -> Column:
    """Vectors that take part: not null, not empty, all components finite, not all zero."""
    parts = F.col(vector).cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(parts, lambda x: x != 0), F.lit(False))


class Graph:
    """Layers of flat neighbour arrays over distinct vectors, searched for largest inner products.

    An extra component gives all vectors one length, so that the nearest by distance is the
    largest by inner product. Layers shrink by ``SHRINK``; the lowest holds all nodes. Nodes are
    put in block by block, each block searching the graph of all blocks before it and itself.
    """

    def __init__(self, points: np.ndarray, layers: list[np.ndarray]):
        self.points, self.layers = points, layers

    @staticmethod
    def lifted(vectors: np.ndarray) -> np.ndarray:
        square = (vectors * vectors).sum(axis=1)
        return np.hstack([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]]).astype(np.float64)

    @classmethod
    def build(cls, vectors: np.ndarray) -> "Graph":
        """Nodes are in a mixed order already, so a layer is a prefix of the nodes."""
        points = cls.lifted(vectors)
        sizes = [len(points)]
        while sizes[-1] > 4 * SHRINK:
            sizes.append(-(-sizes[-1] // SHRINK))
        graph = cls(points, [])
        for size in reversed(sizes):
            graph.layers.insert(0, graph._layer(size))
        return graph

    def _layer(self, size: int) -> np.ndarray:
        """One layer, seeded by an exact small block and then grown."""
        degree = 2 * LINKS
        links = np.full((size, degree), NONE, np.int32)
        done = min(size, 256)
        self._connect(links, np.arange(done), self._exact(np.arange(done), np.arange(done), min(done, BEAM_BUILD + 1)))
        while done < size:
            block = np.arange(done, min(size, 2 * done, done + 2048))
            graph = Graph(self.points, [links[:done], *self.layers])
            found = graph.search(self.points[block], BEAM_BUILD, BEAM_BUILD)[0]
            near = self._exact(block, block, min(len(block), LINKS + 1))
            self._connect(links, block, np.hstack([found, near]))
            done = int(block[-1]) + 1
        return links

    def _exact(self, rows: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
        scores = self.points[rows] @ self.points[among].T
        return among[np.argpartition(-scores, n - 1, axis=1)[:, :n]]

    def _connect(self, links: np.ndarray, block: np.ndarray, candidates: np.ndarray) -> None:
        """Links from each node of a block to chosen candidates, and back."""
        links[block, :LINKS] = self._chosen(block, candidates, LINKS)
        source = np.repeat(block, LINKS)
        target = links[block, :LINKS].ravel()
        source, target = source[target != NONE], target[target != NONE]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(nodes), int(counts.max(initial=1))), NONE, np.int64)
        back[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        for at in range(0, len(nodes), 1024):
            part = nodes[at:at + 1024]
            links[part] = self._chosen(part, np.hstack([links[part], back[at:at + 1024]]), links.shape[1])

    def _chosen(self, nodes: np.ndarray, candidates: np.ndarray, n: int) -> np.ndarray:
        """Up to ``n`` candidates per node: those nearer to it than to one already chosen, then the nearest."""
        candidates = np.sort(candidates, axis=1)
        twin = np.zeros(candidates.shape, bool)
        twin[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
        candidates = np.where(twin | (candidates == nodes[:, None]), NONE, candidates)
        scores = np.einsum("nd,ncd->nc", self.points[nodes], self.points[candidates])
        scores[candidates == NONE] = -np.inf
        width = min(candidates.shape[1], 3 * n)
        by = np.argsort(-scores, axis=1, kind="stable")[:, :width]
        candidates, scores = np.take_along_axis(candidates, by, 1), np.take_along_axis(scores, by, 1)
        vectors = self.points[candidates]
        between = np.einsum("ncd,ned->nce", vectors, vectors)
        spread = np.zeros(candidates.shape, bool)
        count = np.zeros(len(nodes), np.int64)
        for c in range(width):
            nearer = (between[:, c, :] > scores[:, c, None]) & spread
            spread[:, c] = (candidates[:, c] != NONE) & ~nearer.any(axis=1) & (count < n)
            count += spread[:, c]
        order = np.where(candidates == NONE, 2, np.where(spread, 0, 1))
        by = np.argsort(order, axis=1, kind="stable")[:, :n]
        out = np.full((len(nodes), n), NONE, np.int32)
        out[:, :by.shape[1]] = np.take_along_axis(candidates, by, 1)
        return out

    def search(self, queries: np.ndarray, beam: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes and scores for all queries at once, one step of every beam at a time."""
        entry = np.zeros((len(queries), 1), np.int64)
        for layer in reversed(self.layers[1:]):
            entry = self._walk(layer, queries, entry, 8)[0][:, :4]
        nodes, scores = self._walk(self.layers[0], queries, entry, beam)
        return nodes[:, :n], scores[:, :n]

    def _walk(self, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(queries), len(links)
        beam = min(beam, size)
        rows = np.arange(n)
        seen = np.zeros((n, size), bool)
        entry = np.where((entry < size) & (entry >= 0), entry, 0)
        nodes = np.full((n, beam), NONE, np.int64)
        scores = np.full((n, beam), -np.inf)
        opened = np.ones((n, beam), bool)
        fresh = np.sort(entry, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = NONE
        while True:
            valid = fresh != NONE
            seen[np.repeat(rows, valid.sum(axis=1)), fresh[valid]] = True
            gained = np.einsum("nd,ncd->nc", queries, self.points[fresh])
            gained[~valid] = -np.inf
            nodes, scores = np.hstack([nodes, fresh]), np.hstack([scores, gained])
            opened = np.hstack([opened, ~valid])
            by = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
            nodes, scores, opened = (np.take_along_axis(x, by, 1) for x in (nodes, scores, opened))
            waiting = ~opened & (nodes != NONE)
            if not waiting.any():
                return nodes, scores
            # Every beam opens its two best nodes that wait.
            first = np.argsort(~waiting, axis=1, kind="stable")[:, :2]
            chosen = np.where(np.take_along_axis(waiting, first, 1), np.take_along_axis(nodes, first, 1), NONE)
            np.put_along_axis(opened, first, True, 1)
            fresh = np.where(chosen[:, :, None] == NONE, NONE, links[chosen]).reshape(n, -1).astype(np.int64)
            fresh = np.sort(fresh, axis=1)
            twin = np.zeros(fresh.shape, bool)
            twin[:, 1:] = fresh[:, 1:] == fresh[:, :-1]
            known = seen[rows[:, None], fresh] | twin
            fresh = np.where(known, NONE, fresh)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _index_rows(key: str, vector: str):
    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        """One row: distinct vectors, the keys of each in ascending order, and the layers."""
        matrix = _matrix(frame[vector])
        distinct, inverse = np.unique(matrix, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        mixed = np.random.default_rng(len(distinct)).permutation(len(distinct))
        place = np.empty(len(mixed), np.int64)
        place[mixed] = np.arange(len(mixed))
        owner = place[inverse]
        keys = frame[key].to_numpy(np.int64)
        by = np.lexsort((keys, owner))
        graph = Graph.build(distinct[mixed])
        return pd.DataFrame({
            "shard": [int(frame["shard"].iloc[0])], "width": [matrix.shape[1]],
            "vectors": [distinct[mixed].tobytes()], "keys": [keys[by].tobytes()],
            "ends": [np.cumsum(np.bincount(owner, minlength=len(mixed))).astype(np.int64).tobytes()],
            "layers": [[layer.tobytes() for layer in graph.layers]],
        })

    return rows


INDEX = "shard int, width int, vectors binary, keys binary, ends binary, layers array<binary>"


def build_index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: every usable vector with a key, shards dealt by a hash of the key and row.

    Vectors of other lengths are shards of their own. Equal vectors of a shard are one node with a
    list of keys, so a crowd of copies does not shut itself off in the graph.
    """
    good = rows.filter(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    count = good.count()
    shards = max(1, -(-count // shard_rows))
    dealt = good.withColumn("shard", F.pmod(F.xxhash64(key, vector), F.lit(shards)).cast("int"))
    return dealt.withColumn("width", F.size(vector)).groupBy("shard", "width").applyInPandas(_index_rows(key, vector), INDEX)


def search(
    index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", n: int = 20,
    beam: int = BEAM_SEARCH,
) -> DataFrame:
    """Per query row its ``n`` nearest others by inner product: ``query_id``, ``rank``, key, ``score``.

    Blocks of queries meet every shard; each pair of block and shard is one group, and its best
    ``n`` per query are merged. Scores are sums over the vectors as given, in double precision. Ties
    go to the smaller key. The query's own key never answers; queries of null key or without a
    usable vector, and vectors of another length, take no part.
    """
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.filter(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("query")).distinct()
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("width", F.size("query"))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", key, "score"]
        if asking.empty or held.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), key: pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        row = held.iloc[0]
        vectors = np.frombuffer(row["vectors"]).reshape(-1, row["width"])
        keys, ends = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["ends"], np.int64)
        layers = [np.frombuffer(layer, np.int32).reshape(-1, 2 * LINKS) for layer in row["layers"]]
        graph = Graph(Graph.lifted(vectors), layers)
        out = []
        for at in range(0, len(asking), 512):
            part = asking.iloc[at:at + 512]
            points = _matrix(part["query"])
            flat = np.hstack([points, np.zeros((len(points), 1))]).astype(np.float64)
            nodes, _ = graph.search(flat, max(beam, 4 * n), max(beam, 4 * n))
            scores = np.where(nodes == NONE, -np.inf, np.einsum("nd,ncd->nc", points, vectors[nodes]))
            for own, found, values in zip(part["query_id"].to_numpy(), nodes, scores):
                rows: list[tuple[float, int]] = []
                for i in np.argsort(-values, kind="stable"):
                    # A node's first keys are its smallest; one more than asked covers the query's own.
                    if found[i] == NONE or len(rows) > n and values[i] < rows[n][0]:
                        break
                    end, node = ends[found[i]], found[i]
                    first = ends[node - 1] if node else 0
                    rows += [(values[i], int(k)) for k in keys[first:min(end, first + n + 1)] if k != own]
                rows.sort(key=lambda r: (-r[0], r[1]))
                out += [(own, k, score) for score, k in rows[:n]]
        return pd.DataFrame(out, columns=columns)

    found = asked.groupBy("shard", "width", "block").cogroup(spread.groupBy("shard", "width", "block")).applyInPandas(
        answer, f"query_id long, {key} long, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return found.distinct().withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= n).select(
        "query_id", F.col("rank").cast("int").alias("rank"), key, "score")


def nearest(
    rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", n: int = 20,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Builds the index of ``rows``, stores it and searches it for all ``queries``."""
    return search(stored(build_index(rows, key, vector, shard_rows), "graphs"), queries, key, vector, n)
