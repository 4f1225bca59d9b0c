"""Periodic runs of words in a text, by seeds and extension along diagonals.

A run of period q and at least 4 * q (and 6) words repeats max(6 - q, 3 * q) words at lag q. Lags
are taken in classes [2^j, 2^(j+1)); the least overlap of a class, 5, 6, 12, 24, ... words, is the
length k of its seeds. From the second class on k is at least 1.5 lags, so by the theorem of Fine
and Wilf the first k words of a run recur q words on and nowhere in between: of all occurrence
pairs of a seed only neighbours are enumerated, one per position. Each pair is extended both ways
along its diagonal, unless the table of the furthest covered position of its lag holds it.

Seeds are named by pairs of names of half their length, so they are compared exactly, and a seed
that occurs once is followed no further: most texts are done after six words. Many texts are
searched side by side in one array; their words differ by document, so no run crosses over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablemill.llm.common import text_bytes

#: A run has so many periods at least, and so many words.
PERIODS, LEAST_WORDS = 4, 6
#: Words searched side by side, about; a longer text is searched alone.
TOGETHER = 1 << 19


class _Grams:
    """Names of the k-grams that occur more than once, at the positions ``at``; -1 elsewhere."""

    def __init__(self, names: np.ndarray, at: np.ndarray):
        self.names, self.at = names, at

    def then(self, behind: int, other: _Grams) -> _Grams:
        """Grams made of one of these and one of ``other`` that starts ``behind`` words on."""
        at = self.at[self.at < len(self.names) - behind]
        at = at[other.names[at + behind] >= 0]
        return _repeated(self.names[at] * np.int64(len(self.names) + 1) + other.names[at + behind], at, len(self.names))

    def neighbours(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, lag) of each gram that next occurs ``low`` to ``high - 1`` words on."""
        at = self.at[np.argsort(self.names[self.at], kind="stable")]
        lag = np.diff(at)
        near = (self.names[at[1:]] == self.names[at[:-1]]) & (lag >= low) & (lag < high)
        return at[:-1][near], lag[near]


def _repeated(keys: np.ndarray, at: np.ndarray, n: int) -> _Grams:
    codes, _ = pd.factorize(keys)
    again = np.bincount(codes, minlength=1)[codes] > 1
    names = np.full(n, -1, np.int64)
    names[at[again]] = codes[again]
    return _Grams(names, at[again])


def _equal_from(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from ``a`` and from ``b`` (> a) on, forwards or backwards."""
    n, size = 0, 32
    while True:
        size = min(size, len(words) - b - n if step > 0 else a + 1 - n)
        if size <= 0:
            return n
        if step > 0:
            differ = words[a + n : a + n + size] != words[b + n : b + n + size]
        else:
            differ = (words[a - n - size + 1 : a - n + 1] != words[b - n - size + 1 : b - n + 1])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return n + first
        n, size = n + size, size * 4


def periodic_runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs in an array of word numbers, by start and period.

    A run is a stretch of smallest period q, of at least ``PERIODS`` * q and ``LEAST_WORDS``
    words, that no neighbouring word extends.
    """
    n, found = len(words), []
    one = _repeated(np.asarray(words, np.int64), np.arange(n), n)
    two = one.then(1, one)
    three = two.then(2, one)
    grams, k, low, high = three.then(3, two), LEAST_WORDS - 1, 1, 2
    following = three.then(3, three)
    furthest: dict[int, int] = {}
    while len(grams.at):
        at, lag = grams.neighbours(low, high)
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        head = np.ones(len(at), bool)
        head[1:] = (np.diff(at) != 1) | (np.diff(lag) != 0)
        last = at[np.append(np.flatnonzero(head)[1:], len(at)) - 1] if len(at) else at
        for i, j, q in zip(at[head].tolist(), last.tolist(), lag[head].tolist(), strict=True):
            if i < furthest.get(q, 0):
                continue
            start = i - _equal_from(words, i - 1, i - 1 + q, -1)
            end = j + k + _equal_from(words, j + k, j + k + q, 1)
            furthest[q] = end
            length = end - start + q
            if length >= max(LEAST_WORDS, PERIODS * q):
                found.append((start, length, q))
        if low == 1:
            grams, k = following, LEAST_WORDS
        else:
            grams, k = grams.then(k, grams), 2 * k
        low, high = high, 2 * high
    runs = np.array(found, np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _searched(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(number of words, runs, text without what runs repeat) of each text."""
    split = [t.split() for t in texts]
    sizes = [len(s) for s in split]
    ends = np.cumsum([0, *sizes])
    flat = [w for s in split for w in s]
    codes = pa.array(flat, pa.binary()).dictionary_encode()
    width = np.int64(len(codes.dictionary) + 1)
    document = np.repeat(np.arange(len(texts)), sizes)
    words = document * width + codes.indices.to_numpy()
    runs = periodic_runs(words)
    change = np.zeros(len(flat) + 1, np.int32)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    cut = np.searchsorted(runs[:, 0], ends)
    for d, found in enumerate(split):
        mine = runs[cut[d] : cut[d + 1]] - [ends[d], 0, 0]
        if len(mine):
            dropped = gone[ends[d] : ends[d + 1]].tolist()
            found = [w for w, out in zip(found, dropped, strict=True) if not out]
        yield sizes[d], mine, b" ".join(found)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def results(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        counts, runs, kept = zip(*_searched(texts), strict=True)
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        rows = np.concatenate(runs)
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(_RUN)))
        columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), listed, pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "kept"])

    for batch in batches:
        ids, texts, size = [], [], 0
        for id_, text in zip(*batch.columns, strict=True):
            ids.append(id_.as_py())
            texts.append(text.as_py() or b"")
            # A word and the white space behind it take 6 bytes or so.
            size += len(texts[-1]) // 6
            if size >= TOGETHER:
                yield results(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield results(ids, texts)


def runs_and_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, kept_text) for every row of ``docs``.

    Words are stretches without ASCII white space, numbered from 0. ``runs`` holds (start, length,
    period) by start, then period; runs may overlap. ``kept_text`` has the words, joined by one
    space, that no run holds after its first period. NULL counts as an empty text: no words, no
    runs, an empty rest. A NULL id is kept; rows of one id are texts of their own. An empty table
    gives an empty one. Extra columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("t"))
    found = rows.mapInArrow(_search, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept binary")
    return found.select(F.col("id").alias("doc_id"), "n_words", "runs", F.col("kept").cast("string").alias("kept_text"))


__all__ = ["periodic_runs", "runs_and_rest"]
