"""What the vector searches share: usable rows, shards as single rows, blocks of queries, best k."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.session import staged

#: Rows of a shard. A shard's vectors travel as one value: some MB at usual dimensions.
SHARD_ROWS = 4096
#: Queries that meet a shard at once, about.
QUERY_BLOCK = 512
#: Vectors that coarse centres are fitted on, at most, and centres, at most.
SAMPLE_ROWS = 20_000
MOST_REGIONS = 1024


def pieces(rows: int, per_piece: int) -> int:
    """How many pieces of about ``per_piece`` rows hold ``rows``."""
    return max(1, -(-rows // per_piece))


def usable(df: DataFrame, id_col: str, vec_col: str, component: Callable[[Column], Column], nonzero: bool) -> DataFrame:
    """(id, name, v): the rows that take part, ``v`` an array of doubles.

    ``name`` is the row's id in ``df``; ``id`` is a number of its own, so rows that share a name
    stay apart, each a query or a candidate for itself. Left out are rows with a NULL id, a NULL
    or empty vector, a NULL or non-finite component or, if asked, only zeros. Vectors of all
    dimensions take part; each meets those of its own.
    """
    x = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    keep = F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad
    if nonzero:
        keep = keep & F.exists(x, lambda c: c != 0)
    name, v = F.col(f"`{id_col}`").cast("long").alias("name"), F.transform(x, component).cast("array<double>").alias("v")
    # Written before anything reads the numbers, so a rerun task can't give others.
    return staged(df.where(keep).select(F.monotonically_increasing_id().alias("id"), name, v), "vectors")


def by_dimension(rows: DataFrame, every: int, search: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """``search`` over the rows of each dimension that has queries, all results together.

    A search gives (query, rank, id, score), with the queries as row numbers; here they get
    their names back. Dimensions are taken to be few: each is a search of its own.
    """
    asked = F.count_if(F.col("name") % every == 0)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(asked.alias("asked")).orderBy("d").collect()
    parts = [search(rows if len(sizes) == 1 else rows.where(F.size("v") == s.d)) for s in sizes if s.asked]
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    names = rows.where(F.col("name") % every == 0).select(F.col("id").alias("query"), F.col("name").alias("query_id"))
    found = reduce(DataFrame.unionAll, parts).join(names, "query")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(value: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(value), allow_pickle=False) as found:
        return dict(found)


def sampled(rows: DataFrame, most: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``most`` vectors, those with the least hash of their id."""
    found = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow()
    return matrix(found.column("v"))


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from far-spread starts; fewer if there are fewer points apart."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = nearest(points, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, squared distance to it) per point."""
    index, least = np.empty(len(points), np.int64), np.empty(len(points))
    norms = (centres**2).sum(axis=1)
    for at in range(0, len(points), 8192):
        part = points[at : at + 8192]
        far = norms - 2 * part @ centres.T
        index[at : at + 8192] = far.argmin(axis=1)
        least[at : at + 8192] = np.maximum(0, far.min(axis=1) + (part**2).sum(axis=1))
    return index, least


def in_shards(
    rows: DataFrame, group: str, shard_rows: int = SHARD_ROWS, together: bool = False
) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``rows`` with ``shard``, and {group: (first shard, shards)}.

    A group (there are boundedly many) that is larger than a shard is dealt over several by
    the hash of the id, so a vector that a third of the rows share fills no task. With
    ``together`` small groups in a row share a shard as far as they fit.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(group).collect()
    spans, at, room = {}, 0, 0
    for r in counts:
        if together and r.n <= room:
            spans[r[group]] = (at - 1, 1)
            room -= r.n
            continue
        spans[r[group]] = (at, -(-r.n // shard_rows))
        at += spans[r[group]][1]
        room = shard_rows - r.n
    if not spans:
        return rows.withColumn("shard", F.lit(0)), spans
    listed = [(g, a, n) for g, (a, n) in spans.items()]
    dealt = F.broadcast(rows.sparkSession.createDataFrame(listed, "g int, first int, shards int"))
    out = rows.join(dealt, F.col(group) == F.col("g"))
    shard = F.col("first") + F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")
    return out.withColumn("shard", shard).drop("g", "first", "shards"), spans


def met(asked: DataFrame, shards: DataFrame, blocks: int, search: Callable, schema: str, also: str) -> DataFrame:
    """Queries ``asked`` (shard, query, v, ``also``) and ``shards`` (shard, data) brought together.

    ``search(data, ids, vectors, also)`` gets a shard and a block of the queries that ask for
    it, and returns arrays of query, id and score.
    """
    block = F.pmod(F.xxhash64("query"), F.lit(max(1, blocks)))
    lists = asked.groupBy("shard", block.alias("block")).agg(F.collect_list(F.struct("query", "v", also)).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, wanted in zip(batch.column(0), batch.column(1), strict=True):
                queries = wanted.values
                ids = queries.field("query").to_numpy(zero_copy_only=False)
                found = search(unpacked(data.as_py()), ids, matrix(queries.field("v")), queries.field(also))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query", "id", "score"])

    return lists.join(shards, "shard").select("data", "asked").mapInArrow(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query, ties to the smaller id, with their rank."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.nonzero(scores >= least)[0]
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]
