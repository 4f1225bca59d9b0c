"""Best-fit packing of documents into sequences of several permitted lengths.

Longest pieces first, each piece goes into the open bin that it fills best. If none has room,
a bin is opened at the size that costs least per word it can be filled with, as the sizes of
the pieces still to come tell, and in the end each bin is downsized to the shortest permitted
length that holds its contents. A sequence costs more per word the longer it is, and what is
not filled is paid for too: short sequences and full ones are both wanted. A document longer
than the longest sequence is cut into pieces of that length and a rest. Pieces are dealt over
shards of bounded size that are packed side by side, each without looking at the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablemill.llm.common import WORD, small_batches
from tablemill.llm.mixing import word_count
from tablemill.llm.vectors import pieces
from tablemill.session import staged

CAPACITIES = (512, 1024, 2048, 4096)
#: A sequence of c words costs ``OVERHEAD`` + c + c * c / ``QUADRATIC``: every word of it is worked on,
#: filled or not, and looks at all the others.
OVERHEAD, QUADRATIC = 16, 8192
#: Pieces of a shard, about.
SHARD_PIECES = 50_000


def sequence_cost(capacity: int, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    return overhead + capacity + capacity * capacity / quadratic


def _filled(size: int, capacity: int, sizes: int, many: list[int]) -> int:
    """Words that a new bin gets from a piece and the longest ones to come that fit, one after the other.

    ``sizes`` has a bit for each size still to come, ``many`` how many there are of it.
    """
    left = capacity - size
    sizes &= (1 << (left + 1)) - 1
    while sizes:
        top = sizes.bit_length() - 1
        left -= top * min(many[top], left // top)
        sizes &= (1 << min(top, left + 1)) - 1
    return capacity - left


def best_fit(
    sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC
) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its place in the bin, final capacity of each bin).

    ``sizes`` come longest first; none is over the largest capacity. Room that is left is kept
    as bits of one number, so the best fit is the lowest bit at or above a size. A new bin gets
    the capacity that costs least per word it can be filled with, and in the end the least that
    holds its contents.
    """
    capacities = sorted(capacities)
    cost = {c: sequence_cost(c, overhead, quadratic) for c in capacities}
    many = [0] * (capacities[-1] + 1)
    coming = 0
    for size in sizes:
        many[size] += 1
        coming |= 1 << size
    shortest = {f: next(c for c in capacities if c >= f) for f in range(1, capacities[-1] + 1)}
    room, bins = 0, {}
    which, place, filled = [], [], []
    for size in sizes:
        many[size] -= 1
        if not many[size]:
            coming ^= 1 << size
        fits = room >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            stack = bins[left]
            b = stack.pop()
            if not stack:
                room ^= 1 << left
        else:
            fills = [(c, _filled(size, c, coming, many)) for c in capacities if c >= size]
            left = min(fills, key=lambda x: (cost[shortest[x[1]]] / x[1], x[0]))[0]
            b = len(filled)
            filled.append(0)
        which.append(b)
        place.append(filled[b])
        filled[b] += size
        left -= size
        if left:
            bins.setdefault(left, []).append(b)
            room |= 1 << left
    return which, place, [shortest[f] for f in filled]


def packed_pieces(
    lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """(id, piece, start, n_words, bin_id, capacity, place) for rows (row, id, n) of ``lengths``.

    ``row`` is unique and tells rows of one id apart.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("at least one permitted length is needed, and none under 1")
    longest = max(capacities)
    piece = F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("n") - 1), F.lit(longest).cast("long"))).alias("piece", "start")
    cut = lengths.select("row", "id", "n", piece)
    cut = cut.select("row", "id", "piece", "start", F.least(F.lit(longest).cast("long"), F.col("n") - F.col("start")).alias("n_words"))
    empty = cut.where("n_words = 0")
    part = cut.where("n_words > 0")
    shards = pieces(part.count(), shard_pieces)

    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        sizes = table.column("n_words").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("row").to_numpy(), -sizes))
        which, place, capacity = best_fit(sizes[order].tolist(), capacities, overhead, quadratic)
        which = np.array(which, np.int64)
        table = table.take(pa.array(order)).drop_columns(["shard"])
        table = table.append_column("bin_id", pa.array((np.int64(shard) << 32) + which))
        table = table.append_column("capacity", pa.array(np.array(capacity, np.int64)[which]))
        return table.append_column("place", pa.array(place, pa.int64()))

    schema = "row long, id long, piece int, start long, n_words long, bin_id long, capacity long, place long"
    dealt = part.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(pack, schema)
    none = F.lit(None).cast("long")
    return packed.unionAll(empty.select("*", none, none, none))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), word_count(F.col(f"`{text_col}`")).alias("n"))


def packing(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: Sequence[int] = CAPACITIES,
    overhead: float = OVERHEAD,
    quadratic: float = QUADRATIC,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """(doc_id, piece, start, n_words, bin_id, capacity, place) for each piece of each document.

    A piece is ``n_words`` words from word ``start`` of its document, and stands at word ``place``
    of sequence ``bin_id``, which is ``capacity`` words long. A document without words (NULL,
    empty) has one piece of no words and no sequence. A NULL id is kept; rows of one id are
    documents of their own. An empty table gives an empty one. Extra columns are ignored.
    """
    lengths = staged(_numbered(docs, id_col, text_col), "pack-lengths")
    return packed_pieces(lengths, capacities, overhead, quadratic, shard_pieces).select(F.col("id").alias("doc_id"), "piece", "start", "n_words", "bin_id", "capacity", "place")


def _located(docs: DataFrame, id_col: str, text_col: str, stored: bool) -> DataFrame:
    """(file, at, id, text): each row with the place where it is read, the same in every reading."""
    columns = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")]
    if not stored:
        docs = staged(docs.select(*columns), "pack-texts")
        columns = ["id", "text"]
    return docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), *columns)


def packed_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: Sequence[int] = CAPACITIES,
    overhead: float = OVERHEAD,
    quadratic: float = QUADRATIC,
    shard_pieces: int = SHARD_PIECES,
    stored: bool = False,
) -> DataFrame:
    """``packing`` with each piece's ``text``; pieces of a document joined give its text back.

    Documents without words are in no sequence and left out. ``stored`` says that ``docs`` are the
    rows of Parquet files as they are there; other frames are written first, to be read twice.
    """
    small_batches(docs.sparkSession)
    held = _located(docs, id_col, text_col, stored)
    lengths = held.select(F.monotonically_increasing_id().alias("row"), "file", "at", "id", word_count(F.col("text")).alias("n"))
    lengths = staged(lengths, "pack-lengths")
    layout = packed_pieces(lengths, capacities, overhead, quadratic, shard_pieces).where("n_words > 0")
    per = layout.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "piece", "n_words", "bin_id", "capacity", "place"))).alias("parts"))
    per = staged(per.join(lengths.select("row", "file", "at"), "row").drop("row"), "pack-layout")
    joined = held.join(per, ["file", "at"]).select("id", "text", "parts")
    word = re.compile(WORD)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "n_words", "bin_id", "capacity", "place", "text"]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string()]
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows, size = [], 0
            for id_, text, parts in zip(*batch.columns, strict=True):
                body, found = text.as_py(), parts.as_py()
                ends = [0, len(body)]
                if len(found) > 1:
                    firsts = {p["start"] for p in found[1:]}
                    ends = [0, *(m.start() for k, m in enumerate(word.finditer(body)) if k in firsts), len(body)]
                rows += [(id_.as_py(), *(p[c] for c in names[1:7]), body[a:b]) for p, a, b in zip(found, ends[:-1], ends[1:], strict=True)]
                size += len(body)
                if size > 1 << 22:  # texts are handed on some MB at a time
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return joined.mapInArrow(cut, "doc_id long, piece int, start long, n_words long, bin_id long, capacity long, place long, text string")


__all__ = ["best_fit", "packed_pieces", "packed_texts", "packing"]
