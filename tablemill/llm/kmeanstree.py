"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and every row is put into a leaf. Vectors first get one
more component that brings them to one length, after which the largest inner product is the
least distance. A query keeps a queue of unexplored branches by the distance to their centre,
walks down the nearest, and comes back to the best bin left, so leaves come in order of
promise. How many are visited is widened until queries whose true neighbours are known find
the wanted share of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablemill.llm.vectors import (
    QUERY_BLOCK, SHARD_ROWS, best, best_of, by_dimension, in_shards, kmeans, matrix, met, nearest, packed, pieces, sampled, usable,
)
from tablemill.session import staged

#: Rows the tree is fitted on, at most; children of a node; rows of a leaf, about; leaves, at most.
FIT_ROWS = 20_000
BRANCHES = 8
LEAF_ROWS = 256
MOST_LEAVES = 4096
#: Queries whose true neighbours are looked up to set the number of visits, at most, and the
#: share of these neighbours that must be found.
TRIAL_QUERIES = 200
RECALL = 0.96


class Tree:
    """Centres and first children of the nodes (children lie side by side; a leaf's is 0)."""

    def __init__(self, points: np.ndarray, leaf_points: float, branches: int = BRANCHES):
        self.centres, self.child, self.count, self.leaf = [points.mean(axis=0)], [0], [0], [-1]
        waiting, leaves = [(0, points)], 0
        while waiting:
            node, inside = waiting.pop()
            centres = kmeans(inside, branches, seed=node) if len(inside) > leaf_points else inside[:0]
            if len(centres) < 2:
                self.leaf[node], leaves = leaves, leaves + 1
                continue
            part = nearest(inside, centres)[0]
            self.child[node], self.count[node] = len(self.centres), len(centres)
            for k, c in enumerate(centres):
                waiting.append((len(self.centres), inside[part == k]))
                self.centres.append(c)
                self.child.append(0)
                self.count.append(0)
                self.leaf.append(-1)
        self.centres, self.leaves = np.array(self.centres), leaves

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf each point falls into, by the nearest child at each level."""
        out = np.zeros(len(points), np.int64)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            first, n = self.child[node], self.count[node]
            if not n:
                out[rows] = self.leaf[node]
            elif len(rows):
                part = nearest(points[rows], self.centres[first : first + n])[0]
                waiting += [(first + k, rows[part == k]) for k in range(n)]
        return out

    def visits(self, vectors: np.ndarray) -> Iterator[Iterator[int]]:
        """For each vector its leaves, best bin first, as far as they are asked for."""
        far = ((self.centres**2).sum(axis=1) - 2 * vectors @ self.centres.T).tolist()
        for distance in far:
            yield self._best_bins(distance)

    def _best_bins(self, distance: list[float]) -> Iterator[int]:
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.count[node]:
                children = range(self.child[node], self.child[node] + self.count[node])
                near = min(children, key=distance.__getitem__)
                for c in children:
                    if c != near:
                        heapq.heappush(queue, (distance[c], c))
                node = near
            yield self.leaf[node]


def _lengthened(points: np.ndarray, longest: float) -> np.ndarray:
    """Points with one more component, all of length ``longest``."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (points**2).sum(axis=1)))
    return np.column_stack([points, rest])


def _asked(vectors: np.ndarray) -> np.ndarray:
    """Queries with a zero as that component."""
    return np.column_stack([vectors, np.zeros(len(vectors))])


def exact_products(points: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner product of each pair of rows, added up component by component.

    Unlike a matrix product's, the order of the additions doesn't depend on where a row stands,
    so equal vectors score the same and ties are ties.
    """
    out = np.zeros(len(points))
    for k in range(points.shape[1]):
        out += points[:, k] * vectors[:, k]
    return out


def search(data: dict[str, np.ndarray], ids: np.ndarray, vectors: np.ndarray, k: int, visits: list[set[int]] | None = None) -> tuple[np.ndarray, ...]:
    """(query, place in the shard, score) of each query's ``k`` best rows of a shard, of all or of the leaves it visits.

    Ties go to the smaller name.
    """
    points, rows, names = data["points"], data["ids"], data["names"]
    if visits is None:
        rough = vectors @ points.T
    else:
        rough = np.full((len(ids), len(rows)), -np.inf)
        edges = np.flatnonzero(np.diff(data["leaf"], prepend=-1, append=-1))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            leaf = int(data["leaf"][start])
            here = np.array([q for q, seen in enumerate(visits) if leaf in seen], np.int64)
            rough[here, start:end] = vectors[here] @ points[start:end].T
    rough[ids[:, None] == rows] = -np.inf
    if len(rows) > k:
        least = np.partition(rough, len(rows) - k, axis=1)[:, len(rows) - k]
    else:
        least = np.full(len(ids), -np.inf)
    slack = 1e-12 * (1 + np.abs(points).max(initial=0) * np.abs(vectors).sum(axis=1))
    query, row = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
    scores = np.concatenate([exact_products(points[row[a : a + 65536]], vectors[query[a : a + 65536]]) for a in range(0, len(row), 65536)] or [np.zeros(0)])
    cuts = np.searchsorted(query, np.arange(len(ids) + 1))
    kept = [a + best_of(scores[a:b], names[row[a:b]], k) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    kept = np.concatenate([np.zeros(0, np.int64), *kept])
    return ids[query[kept]], row[kept], scores[kept]


def calibrated(tree: Tree, trials: np.ndarray, leaves: np.ndarray, per_query: np.ndarray, recall: float) -> int:
    """The least number of visits that finds the share ``recall`` of known neighbours.

    ``trials`` are query vectors, ``leaves[i]`` is the leaf of a true neighbour of query
    ``per_query[i]``.
    """
    if not len(leaves):
        return tree.leaves
    turn = np.empty((len(trials), tree.leaves), np.int64)
    for q, order in enumerate(tree.visits(_asked(trials))):
        turn[q, list(order)] = np.arange(1, tree.leaves + 1)
    needed = np.sort(turn[per_query, leaves])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def neighbours(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    recall: float = RECALL,
    fit_rows: int = FIT_ROWS,
    leaf_rows: int = LEAF_ROWS,
    trial_queries: int = TRIAL_QUERIES,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found by inner product.

    Queries are the rows whose id is divisible by ``every``; all other rows of the same dimension
    are candidates, also rows of the query's id. The score is the inner product of the original vectors in double precision; ties go to the
    smaller id. With no more candidates than ``k`` all are returned, and fewer than ``k`` only if
    there are fewer: a query whose leaves hold too few rows visits all. Which rows take part is
    said at ``vectors.usable``; zero vectors don't. No usable row gives an empty result. Extra
    columns are ignored.
    """
    rows = usable(df, id_col, vec_col, lambda x: x, nonzero=True)
    schema = "query_id long, rank int, vec_id long, score double"
    return by_dimension(rows, every, lambda part: _searched(part, every, k, recall, fit_rows, leaf_rows, trial_queries, shard_rows), schema)


def _searched(
    rows: DataFrame, every: int, k: int, recall: float, fit_rows: int, leaf_rows: int, trial_queries: int, shard_rows: int
) -> DataFrame:
    """(query, rank, id, score) over ``rows`` (id, name, v) of one dimension."""
    is_query = F.col("name") % every == 0
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, queries_n, longest = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.sqrt(squared))).first()
    sample = _lengthened(sampled(rows, fit_rows), longest)
    wanted = min(MOST_LEAVES, pieces(n, leaf_rows))
    tree = Tree(sample, max(4.0, len(sample) / wanted))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(_lengthened(matrix(batch.column(2)), longest)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], ["id", "name", "v", "leaf"])

    indexed = staged(rows.mapInArrow(placed, "id long, name long, v array<double>, leaf int"), "ann-index")
    # Neighbouring leaves share a shard, so a query hands on its best rows per shard, not per leaf.
    dealt, spans = in_shards(indexed, "leaf", shard_rows, together=True)

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("leaf", "ascending"), ("id", "ascending")])
        ids, names = table.column("id").to_numpy(), table.column("name").to_numpy()
        data = packed(ids=ids, names=names, leaf=table.column("leaf").to_numpy(), points=matrix(table.column("v")))
        return pa.table({"shard": table.column("shard").slice(0, 1), "data": pa.array([data], pa.binary())})

    shards = staged(dealt.select("shard", "id", "name", "v", "leaf").groupBy("shard").applyInArrow(shard, "shard int, data binary"), "ann-shards")
    queries = indexed.where(is_query).select(F.col("id").alias("query"), "v")
    trials = queries.orderBy(F.xxhash64("query"), "query").limit(trial_queries).toArrow()
    trial_ids, trial_vectors = trials.column("query").to_numpy(), matrix(trials.column("v"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, names, leaf = (batch.column(c).to_numpy() for c in (0, 1, 3))
            data = {"ids": ids, "names": names, "points": matrix(batch.column(2))}
            query, at, score = search(data, trial_ids, trial_vectors, k)
            found = [pa.array(query), pa.array(names[at]), pa.array(score), pa.array(leaf[at])]
            yield pa.RecordBatch.from_arrays(found, ["query", "id", "score", "leaf"])

    found_schema = "query long, id long, score double"
    truth = indexed.mapInArrow(compared, found_schema + ", leaf int")
    truth = best(truth, k).select("query", "leaf").toArrow()
    place = {q: i for i, q in enumerate(trial_ids.tolist())}
    per_query = np.array([place[q] for q in truth.column("query").to_pylist()], np.int64)
    visits = calibrated(tree, trial_vectors, truth.column("leaf").to_numpy(), per_query, recall)
    sizes = {leaf: 0 for leaf in range(tree.leaves)} | {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, shard, leaves = [], [], []
                for q, order in enumerate(tree.visits(_asked(matrix(part.column(1))))):
                    seen, wanted = 0, {}
                    for turn, leaf in enumerate(order):
                        # One row more than asked for, as the query itself doesn't count.
                        if turn >= visits and seen > k:
                            break
                        seen += sizes[leaf]
                        first, many = spans.get(leaf, (0, 0))
                        for s in range(first, first + many):
                            wanted.setdefault(s, []).append(leaf)
                    row += [q] * len(wanted)
                    shard += wanted
                    leaves += wanted.values()
                index = pa.array(row, pa.int64())
                lists = pa.array(leaves, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(c.take(index) for c in part.columns), lists], ["shard", "query", "v", "leaves"])

    asked = queries.mapInArrow(routed, "shard int, query long, v array<double>, leaves array<int>")

    def look(data: dict[str, np.ndarray], ids: np.ndarray, vectors: np.ndarray, leaves: pa.Array) -> tuple[np.ndarray, ...]:
        query, at, score = search(data, ids, vectors, k, [set(x) for x in leaves.to_pylist()])
        return query, data["names"][at], score

    found = met(asked, shards, pieces(queries_n, QUERY_BLOCK), look, found_schema, "leaves")
    return best(found, k).select("query", "rank", "id", "score")
