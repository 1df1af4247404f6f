"""Exact inner-product top-k by branch and bound over ball trees.

Every shard of the vectors carries a ball tree. For a query, no vector in a ball
scores above ``q . centre + |q| * radius``, so balls whose bound is below the
query's k-th best score so far are left out whole. Shards searched in one task
pass that score on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.sources.staging import stage

#: Vectors of a shard and of a leaf, queries of a block, shards that a task searches one after the other.
SHARD, LEAF, BLOCK, CHAIN = 8192, 128, 2048, 4


def finite(vector: str) -> Column:
    """False for null vectors and those with null or non-finite components."""
    return F.expr(f"{vector} IS NOT NULL AND size({vector}) > 0 AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")


def ball_tree(vectors: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Order of the rows and nodes ``(start, end, centre, radius, left, right)``; leaves have children -1.

    A node is split at the median along the line between two far-apart rows, so
    equal vectors make balanced trees as well.
    """
    order, nodes = np.arange(len(vectors)), []

    def grow(start: int, end: int) -> int:
        rows = vectors[order[start:end]]
        centre = rows.mean(axis=0)
        distance = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        at = len(nodes)
        nodes.append(None)
        left = right = -1
        if end - start > LEAF:
            one = rows[distance.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(rows @ (other - one), half)]
            left, right = grow(start, start + half), grow(start + half, end)
        # a hair wider, for rounding
        nodes[at] = (start, end, centre, float(distance.max()) * (1 + 1e-9) + 1e-9, left, right)
        return at

    if len(vectors):
        grow(0, len(vectors))
    return order, nodes


def shards(vectors: DataFrame) -> DataFrame:
    """``(shard, blob)``: round-robin shards of ``vectors(vec_id, v)``, each with its ball tree."""
    count = -(-max(vectors.count(), 1) // SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
        if ids:
            matrix = padded(rows)
            order, nodes = ball_tree(matrix)
            blob = pickle.dumps((np.array(ids, np.int64)[order], matrix[order], nodes))
            yield pa.RecordBatch.from_arrays([pa.array([min(ids)]), pa.array([blob], pa.binary())], ["shard", "blob"])

    return vectors.select("vec_id", "v").repartition(count).mapInArrow(run, "shard long, blob binary")


def padded(rows: list[list[int]], width: int = 0) -> np.ndarray:
    """Rows as doubles; shorter ones end in zeros."""
    out = np.zeros((len(rows), max(width, *(len(r) for r in rows))))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Best:
    """The ``k`` best ``(score, vec_id)`` of each query of a block."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def visit(self, ids: np.ndarray, rows: np.ndarray, nodes: list[tuple]) -> None:
        width = max(rows.shape[1], self.queries.shape[1])
        rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
        queries = np.pad(self.queries, ((0, 0), (0, width - self.queries.shape[1])))
        leaves = [n for n in nodes if n[4] < 0]
        centres = np.pad(np.array([n[2] for n in leaves]), ((0, 0), (0, width - len(leaves[0][2]))))
        # bounds of the leaves decide what each query looks at first
        bounds = queries @ centres.T + self.norms[:, None] * np.array([n[3] for n in leaves])
        first = bounds.argmax(axis=1)
        for leaf in np.unique(first):
            self.score(np.flatnonzero(first == leaf), queries, ids, rows, leaves[leaf])
        done = {id(n): np.flatnonzero(first == i) for i, n in enumerate(leaves)}

        def descend(at: int, active: np.ndarray) -> None:
            start, end, centre, radius, left, right = node = nodes[at]
            centre = np.pad(centre, (0, width - len(centre)))
            bound = queries[active] @ centre + self.norms[active] * radius
            # an equal score can still win by a smaller id
            active = active[bound * (1 + 1e-12) + 1e-6 >= self.scores[active, -1]]
            if not len(active):
                return
            if left < 0:
                self.score(np.setdiff1d(active, done[id(node)], True), queries, ids, rows, node)
                return
            ahead = [(-(queries[active] @ np.pad(nodes[c][2], (0, width - len(nodes[c][2])))
                        + self.norms[active] * nodes[c][3]).mean(), c) for c in (left, right)]
            for _, child in sorted(ahead):  # the more promising ball first
                descend(child, active)

        descend(0, np.arange(len(queries)))

    def score(self, active: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, node: tuple) -> None:
        if not len(active):
            return
        ids, rows = ids[node[0] : node[1]], rows[node[0] : node[1]]
        scores = queries[active] @ rows.T
        scores[self.query_ids[active][:, None] == ids[None, :]] = -np.inf
        least = self.scores[active, -1]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        at, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(at):
            return
        who, where = np.unique(at, return_inverse=True)
        owner = np.concatenate([where, np.repeat(np.arange(len(who)), self.k)])
        value = np.concatenate([scores[at, col], self.scores[active[who]].ravel()])
        named = np.concatenate([ids[col], self.ids[active[who]].ravel()])
        order = np.lexsort((named, -value, owner))
        owner, value, named = owner[order], value[order], named[order]
        starts = np.searchsorted(owner, np.arange(len(who)))
        take = starts[:, None] + np.arange(self.k)
        self.scores[active[who]], self.ids[active[who]] = value[take], named[take]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best integer inner products of each query, ties to the smaller id.

    Both tables are ``(vec_id long, v array<long>)``, without null ids, vectors
    or components. A query's own id is no candidate; with fewer candidates than
    ``k`` all come back. Equal vectors are ranked by id; repeated rows count once
    each as candidates and once as a query. Shorter vectors count as ended by
    zeros. Scores are exact up to 2**53. Empty tables give no rows.

    Every block of queries meets every shard, as exact search needs; a task holds
    one block and one shard at a time.
    """
    built = stage(shards(vectors), "shards")
    count = -(-max(built.count(), 1) // CHAIN)
    chains = built.select("blob", F.pmod(F.xxhash64("shard"), F.lit(count)).alias("chain"))
    asked = stage(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = -(-max(asked.count(), 1) // BLOCK)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
        if ids:
            blob = pickle.dumps((np.array(ids, np.int64), padded(rows)))
            block = pa.array([TaskContext.get().partitionId()])
            yield pa.RecordBatch.from_arrays([block, pa.array([blob], pa.binary())], ["block", "queries"])

    packed = stage(asked.repartition(blocks).mapInArrow(gather, "block long, queries binary"), "blocks")
    met = chains.select("*", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Any = None
        best: Best | None = None
        for batch in batches:
            for block, chain, queried, blob in zip(*batch.columns, strict=True):
                key = block.as_py(), chain.as_py()
                if key != current:
                    if best is not None:
                        yield _rows(best)
                    current, best = key, Best(*pickle.loads(queried.as_py()), k)
                best.visit(*pickle.loads(blob.as_py()))
        if best is not None:
            yield _rows(best)

    pairs = met.join(packed, "block").select("block", "chain", "queries", "blob")
    dealt = pairs.repartition("block", "chain").sortWithinPartitions("block", "chain")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _rows(best: Best) -> pa.RecordBatch:
    some = best.scores > -np.inf
    owners = np.repeat(best.query_ids, best.k).reshape(best.scores.shape)
    return pa.RecordBatch.from_arrays(
        [pa.array(owners[some]), pa.array(best.ids[some]), pa.array(best.scores[some].astype(np.int64))],
        ["query_id", "vec_id", "score"])


def quantised(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v)``: components as ``floor(256 * x)`` in doubles; unusable vectors and null ids take no part."""
    usable = embeddings.where("vec_id IS NOT NULL").where(finite("embedding"))
    return usable.selectExpr(
        "CAST(vec_id AS LONG) AS vec_id", "transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS LONG)) AS v")
