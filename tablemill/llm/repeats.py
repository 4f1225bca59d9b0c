"""Removal of passages that repeat across documents, found by difference-cover anchors.

A difference cover of a period holds, for every shift, two members that far apart. Let only
windows that start at cover positions (position modulo the period in the cover) be anchors.
Then wherever two documents agree in so many words as an anchor and a period together, some
anchor starts in both at the same place of the passage, however their positions are shifted.
With passages of 50 words, a period of 13 and its perfect cover of four, an anchor has 38
words and starts at every third word or so.

Anchors that two documents share mark the places to look at. There each window of full length
that holds such an anchor is hashed (84 bits), and the least document of each window decides.
The work is in proportion to the words in shared passages: no pairs of documents are formed,
so a passage of a third of all documents costs what its words cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablemill.llm.common import Gathered, release, small_batches, text_bytes
from tablemill.session import delete_path, work_path

PASSAGE = 50
PERIOD = 13
COVER = (0, 1, 3, 9)  # each remainder of 13 but 0 is one difference of these, once
#: A window's place and second hash in one number: 20 bits of hash, 14 that tell texts of one
#: id apart, and 30 for the word it starts at (a text of 2 GB, the most Spark holds, has 2^30).
TAG_BITS, START_BITS = 14, 30
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def covers(cover: tuple[int, ...], period: int) -> bool:
    """Whether every shift is a difference of two members."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser, so that all bits of a hash depend on all of its input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of any window of a document's words, by running polynomial sums modulo 2^64."""

    def __init__(self, hashes: np.ndarray, base: np.uint64):
        n = len(hashes)
        self.powers = np.ones(n + 1, np.uint64)
        self.inverse = np.ones(n + 1, np.uint64)
        if n:
            self.powers[1:] = base
            np.cumprod(self.powers, out=self.powers)
            self.inverse[1:] = np.uint64(pow(int(base), -1, 1 << 64))
            np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.powers[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        return _mixed((self.sums[starts + width] - self.sums[starts]) * self.inverse[starts])


def anchor_starts(n_words: int, width: int, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """Cover positions at which a window of ``width`` words fits."""
    periods = np.arange(0, max(0, n_words - width + 1), period)
    starts = (periods[:, None] + np.array(sorted(cover))).ravel()
    return starts[starts <= n_words - width]


def anchors(rows: DataFrame, passage: int, period: int, cover: tuple[int, ...], places: bool) -> DataFrame:
    """(hash) once per document, or with ``places`` (hash, id, start) for every anchor of ``rows`` (id, t)."""
    width = passage - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Gathered(["hash", "id", "start"] if places else ["hash"])
        for batch in batches:
            for id_, t in zip(*batch.columns, strict=True):
                words = (t.as_py() or b"").split()
                if len(words) < passage:
                    continue
                hashed = Windows(word_hashes(words), _B1)
                starts = anchor_starts(len(words), width, period, cover)
                hashes = hashed.at(starts, width).view(np.int64)
                if places:
                    yield from out.add(hashes, np.full(len(starts), id_.as_py(), np.int64), starts.astype(np.int32))
                else:
                    yield from out.add(np.unique(hashes))
        yield from out.rest()

    return rows.select("id", "t").mapInArrow(run, "hash long, id long, start int" if places else "hash long")


def _tag(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) & ((1 << TAG_BITS) - 1)


def _windows(passage: int, period: int):
    width = passage - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Gathered(["hash", "place", "id"])
        for batch in batches:
            for id_, t, starts in zip(*batch.columns, strict=True):
                text = t.as_py() or b""
                words = text.split()
                s = starts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                # Places are per id: of several texts of one id, a shorter one may lack some.
                s = s[s <= len(words) - width]
                # A window that holds the anchor starts at most period - 1 words before it.
                marks = np.zeros(len(words) + 2, np.int32)
                np.add.at(marks, np.maximum(s - (passage - width), 0), 1)
                np.add.at(marks, s + 1, -1)
                near = np.nonzero(np.cumsum(marks)[: max(0, len(words) - passage + 1)])[0]
                if not len(near):
                    continue
                hashes = word_hashes(words)
                second = Windows(hashes, _B2).at(near, passage) >> np.uint64(TAG_BITS + START_BITS)
                place = (second << np.uint64(TAG_BITS) | np.uint64(_tag(text))) << np.uint64(START_BITS) | near.astype(np.uint64)
                first = Windows(hashes, _B1).at(near, passage)
                yield from out.add(first.view(np.int64), place.view(np.int64), np.full(len(near), id_.as_py(), np.int64))
        yield from out.rest()

    return run


def repeated_windows(
    rows: DataFrame, passage: int = PASSAGE, period: int = PERIOD, cover: tuple[int, ...] = COVER
) -> DataFrame:
    """(id, starts): the windows of each document that also start in one with a smaller id.

    ``rows`` has id (not NULL) and t (the text as bytes). Each of the ``starts`` holds a window's
    first word in its lowest 30 bits and the text's tag in the 14 above.
    """
    if not covers(cover, period) or period > passage:
        raise ValueError("the cover must give every shift of a period no longer than a passage")
    spark = rows.sparkSession
    small_batches(spark)
    made = []

    def written(df: DataFrame, label: str) -> DataFrame:
        path = work_path(spark, label)
        df.write.parquet(path)
        made.append(path)
        return spark.read.schema(df.schema).parquet(path)

    # A document sends an anchor's hash once, so a count over 1 is of two documents.
    shared = written(
        anchors(rows, passage, period, cover, False).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"),
        "anchors-shared",
    )
    release(spark)
    places = written(
        anchors(rows, passage, period, cover, True).join(shared, "hash", "left_semi").groupBy("id").agg(F.collect_set("start").alias("starts")),
        "anchor-places",
    )
    release(spark)
    windows = written(
        rows.join(places, "id").select("id", "t", "starts").mapInArrow(_windows(passage, period), "hash long, place long, id long"),
        "windows",
    )
    release(spark)
    second = F.shiftright("place", TAG_BITS + START_BITS)
    least = written(
        windows.groupBy("hash", second.alias("second"))
        .agg(F.min("id").alias("least"), F.max("id").alias("most"))
        .where("least < most")
        .select(F.col("hash").alias("h"), "second", "least"),
        "windows-least",
    )
    release(spark)
    same = (F.col("hash") == F.col("h")) & (second == F.col("second"))
    place = F.col("place").bitwiseAND((1 << (TAG_BITS + START_BITS)) - 1)
    found = written(
        windows.join(least, same).where("id > least").groupBy("id").agg(F.collect_list(place).alias("starts")),
        "windows-repeated",
    )
    release(spark)
    for path in made[:-1]:
        delete_path(spark, path)
    return found


def kept_words(words: list[bytes], starts: np.ndarray, passage: int) -> tuple[list[bytes], int]:
    """The words that no window starting at ``starts`` covers, and the number of the others."""
    marks = np.zeros(len(words) + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + passage, -1)
    gone = np.cumsum(marks[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    passage: int = PASSAGE,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of ``docs``.

    A word goes if a window of ``passage`` words that covers it also starts, word for word, in a
    row with a smaller id. Windows are judged on the input. Words are runs of anything but ASCII
    white space, as they are; kept ones are joined by a space. NULL and empty texts have no words.
    Rows of one id keep each other's words; a row whose id is NULL is compared with none and
    stays whole. An empty table gives an empty one. Extra columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("t"))
    found = repeated_windows(rows.where("id IS NOT NULL"), passage, period, cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_text"]
        for batch in batches:
            total, removed, kept = [], [], []
            for t, starts in zip(batch.column(1), batch.column(2), strict=True):
                text = t.as_py() or b""
                words = text.split()
                total.append(len(words))
                gone = 0
                if starts.is_valid:
                    s = starts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    s = s[s >> START_BITS == _tag(text)] & ((1 << START_BITS) - 1)
                    words, gone = kept_words(words, s, passage)
                removed.append(gone)
                kept.append(b" ".join(words))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), text], names)

    joined = rows.join(found, "id", "left").select("id", "t", "starts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
