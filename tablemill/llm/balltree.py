"""Exact top-k by inner product: ball trees, searched by branch and bound.

Rows are dealt into shards of neighbouring vectors; each shard is a ball tree. A ball's upper
bound for a query is the product with its centre plus its radius times the query's length.
The search takes balls from a queue in order of that bound and ends when the bound falls under
the current k-th score. Each query first searches the shard it lives in. Its k-th score there
is shared with all other shards: those whose ball can't reach it aren't asked, and the others
start from it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablemill.llm.vectors import (
    MOST_REGIONS, QUERY_BLOCK, SHARD_ROWS, best, best_of, by_dimension, in_shards, kmeans, matrix, met, nearest, packed, pieces, sampled, usable,
)
from tablemill.session import staged

LEAF_ROWS = 128
SCALE = 64


def build(ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS, names: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """A ball tree as arrays: points in tree order; per node its span, first child, centre, radius.

    ``ids`` tell the rows apart; ``names``, by default the same, may repeat.

    A node is cut at the median along the line between two far points. Children lie side by
    side; a leaf's first child is 0.
    """
    order = np.argsort(ids, kind="stable")
    spans, child = [(0, len(ids))], [0]
    at = 0
    while at < len(spans):
        start, end = spans[at]
        if end - start > leaf_rows:
            part = points[order[start:end]]
            a = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            side = np.argsort(part @ (b - a), kind="stable")
            order[start:end] = order[start:end][side]
            middle = (start + end) // 2
            child[at] = len(spans)
            spans += [(start, middle), (middle, end)]
            child += [0, 0]
        at += 1
    points = points[order]
    centres = np.array([points[s:e].mean(axis=0) for s, e in spans]).reshape(len(spans), -1)
    radii = np.array([np.sqrt(((points[s:e] - c) ** 2).sum(axis=1).max(initial=0)) for (s, e), c in zip(spans, centres, strict=True)])
    names = (ids if names is None else names)[order]
    return {"ids": ids[order], "names": names, "points": points, "spans": np.array(spans), "child": np.array(child), "centres": centres, "radii": radii}


def search(tree: dict[str, np.ndarray], ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, name, score) of up to ``k`` best rows per query that score at least its floor."""
    points, rows, names, spans, child = tree["points"], tree["ids"], tree["names"], tree["spans"].tolist(), tree["child"].tolist()
    lengths = np.sqrt((vectors**2).sum(axis=1))
    # Products of whole numbers are exact in doubles below 2^53, else in 64-bit integers.
    if lengths.max(initial=0) * np.sqrt((points**2).sum(axis=1)).max(initial=0) >= 2**52:
        points, vectors_exact = points.astype(np.int64), vectors.astype(np.int64)
    else:
        vectors_exact = vectors
    bounds = vectors @ tree["centres"].T + lengths[:, None] * tree["radii"]
    bounds += 1e-9 * (np.abs(bounds) + lengths[:, None]) + 1e-6
    out_query, out_id, out_score = [], [], []
    for query, vector, bound, floor in zip(ids.tolist(), vectors_exact, bounds.tolist(), floors.tolist(), strict=True):
        scores, found, least = np.zeros(0, points.dtype), np.zeros(0, np.int64), floor
        queue = [(-bound[0], 0)]
        while queue:
            over, node = heapq.heappop(queue)
            if -over < least:
                break
            if child[node]:
                for c in (child[node], child[node] + 1):
                    if bound[c] >= least:
                        heapq.heappush(queue, (-bound[c], c))
                continue
            start, end = spans[node]
            new = points[start:end] @ vector
            good = np.nonzero((new >= least) & (rows[start:end] != query))[0]
            if not len(good):
                continue
            scores = np.concatenate([scores, new[good]])
            found = np.concatenate([found, names[start:end][good]])
            if len(scores) >= k:
                top = best_of(scores, found, k)
                scores, found = scores[top], found[top]
                least = max(least, float(scores[-1]))
        out_query.append(np.full(len(found), query, np.int64))
        out_id.append(found)
        out_score.append(scores.astype(np.int64))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *x]) for x in (out_query, out_id, out_score))


def top_k(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    Components count as floor(64 * x). Queries are the rows whose id is divisible by ``every``;
    all other rows of the same dimension are candidates. Ties go to the smaller id; with fewer
    candidates than ``k`` all are returned. Rows of one id are searched for, and found, each for
    itself. Which rows take part is said at ``vectors.usable``. No usable row gives an empty
    result. Extra columns are ignored.
    """
    rows = usable(df, id_col, vec_col, lambda x: F.floor(x * SCALE), nonzero=False)
    schema = "query_id long, rank int, vec_id long, score long"
    return by_dimension(rows, every, lambda part: _searched(part, every, k, shard_rows), schema)


def _searched(rows: DataFrame, every: int, k: int, shard_rows: int) -> DataFrame:
    """(query, rank, id, score) over ``rows`` (id, name, v) of one dimension."""
    is_query = F.col("name") % every == 0
    n, queries_n = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    centres = kmeans(sampled(rows), min(MOST_REGIONS, pieces(n, shard_rows)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, _ = nearest(matrix(batch.column(2)), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region.astype(np.int32))], ["id", "name", "v", "region"])

    near = staged(rows.mapInArrow(placed, "id long, name long, v array<double>, region int"), "ball-regions")
    dealt, spans = in_shards(near, "region", shard_rows)
    dealt = staged(dealt, "ball-shards")

    def grown(table: pa.Table) -> pa.Table:
        tree = build(table.column("id").to_numpy(), matrix(table.column("v")), names=table.column("name").to_numpy())
        whole = {"shard": table.column("shard").slice(0, 1), "data": pa.array([packed(**tree)], pa.binary())}
        return pa.table({**whole, "centre": pa.array([tree["centres"][0].tolist()]), "radius": pa.array([float(tree["radii"][0])])})

    schema = "shard int, data binary, centre array<double>, radius double"
    trees = staged(dealt.select("shard", "id", "name", "v").groupBy("shard").applyInArrow(grown, schema), "ball-trees")
    asks = dealt.where(is_query).select("shard", F.col("id").alias("query"), "v", "region")
    found_schema, blocks = "query long, id long, score long", pieces(queries_n, QUERY_BLOCK)
    look = lambda data, ids, vectors, floors: search(data, ids, vectors, floors.to_numpy(zero_copy_only=False), k)
    data = trees.select("shard", "data")
    home = staged(met(asks.withColumn("floor", F.lit(float("-inf"))), data, 1, look, found_schema, "floor"), "ball-home")
    kth = best(home, k).where(F.col("rank") == k).select(F.col("query").alias("q"), F.col("score").cast("double").alias("kth"))
    shared = asks.join(kth, F.col("query") == F.col("q"), "left")
    shared = shared.select("query", "v", "shard", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
    # Regions are boundedly many, so the reach of each goes to every task; shards are not.
    reach = np.zeros(len(centres))
    for r in near.select("id", "v", "region").mapInArrow(_reaches(centres), "region int, far double").groupBy("region").agg(F.max("far").alias("far")).collect():
        reach[r.region] = r.far

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, floor = matrix(batch.column(1)), batch.column(3).to_numpy(zero_copy_only=False)
            lengths = np.sqrt((vectors**2).sum(axis=1))
            bound = vectors @ centres.T + lengths[:, None] * reach
            bound += 1e-9 * (np.abs(bound) + lengths[:, None]) + 1e-6
            row, region = np.nonzero(bound >= floor[:, None])
            first = np.array([spans.get(g, (0, 0)) for g in range(len(centres))], np.int64).reshape(-1, 2)[region]
            row, shard = np.repeat(row, first[:, 1]), _ranges(first[:, 0], first[:, 1])
            away = shard != batch.column(2).to_numpy()[row]
            row, shard = row[away], shard[away]
            for at in range(0, len(row), 4096):
                part = pa.array(row[at : at + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[at : at + 4096].astype(np.int32)), *(batch.column(c).take(part) for c in (0, 1, 3))], ["shard", "query", "v", "floor"]
                )

    far = shared.mapInArrow(routed, "shard int, query long, v array<double>, floor double")
    away = met(far, data, blocks, look, found_schema, "floor")
    return best(staged(home.unionAll(away), "ball-found"), k).select("query", "rank", "id", "score")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def _reaches(centres: np.ndarray):
    """(region, largest distance to its centre) per batch of (id, v, region)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = batch.column(2).to_numpy()
            far = np.sqrt(((matrix(batch.column(1)) - centres[region]) ** 2).sum(axis=1)) if len(region) else np.zeros(0)
            names = np.unique(region)
            most = np.array([far[region == g].max() for g in names])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(most, pa.float64())], ["region", "far"])

    return run
