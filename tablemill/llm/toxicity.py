"""Toxicity by maximum-scoring segments.

Words get log-odds of toxic against clean labelled texts, with a Dirichlet prior shaped like
the counts of the whole corpus, so that rare words aren't trusted. A word scores its log-odds
less a constant, which makes clean text drift down. One linear scan over a text then finds
every segment that no longer or shorter one beats: the toxic passages. How high a passage
scores by chance in clean text of that length follows an extreme-value law; its rate comes
from the words of clean texts, its level from the best segments of clean texts. A text's
evidence is the surprise of its best passage and the sum over its significant ones; a
logistic curve, fitted on labelled rows, makes that a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablemill.llm.common import small_batches, staged, text_bytes

#: Labelled rows that are learned from, at most: those with the least hash of their id.
TRAIN_ROWS = 200_000
#: Of these, the rows that fit level and curve, at most.
FIT_ROWS = 40_000
#: Different words that must stand before a word in toxic texts; copies of a text add none.
LEAST_CONTEXTS = 5
#: Different words, or pairs of words, a task holds before it hands them on.
HELD_WORDS = 100_000
PRIOR = 30_000.0
LEAST_Z = 2.0
DRIFT = 0.5
#: Chance that a clean text has such a segment, for a passage to be reported.
SIGNIFICANT = 0.05

#: Texts of kind 0, 1 and -1.
_CLASSES = ("clean", "toxic", "other")
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: bytes | None) -> list[str]:
    """Runs of letters and digits, in small letters."""
    return _TOKEN.findall((text or b"").decode("utf-8", "replace").lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in one pass; the end is exclusive.

    A segment is maximal if every proper part of it scores less and no longer segment has that
    property too. Each candidate remembers the last one before it that starts on a lower running
    sum, which keeps the search linear.
    """
    rises = np.nonzero(scores > 0)[0]
    if not len(rises):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    low, high, start, end, link = [], [], [], [], []
    for i in rises.tolist():
        at, under, top = i, sums[i], sums[i + 1]
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= under:
                j = link[j]
            if j < 0 or high[j] >= top:
                break
            at, under = start[j], low[j]
            del low[j:], high[j:], start[j:], end[j:], link[j:]
        low.append(under)
        high.append(top)
        start.append(at)
        end.append(i + 1)
        link.append(j)
    return [(s, e, float(h - l)) for s, e, h, l in zip(start, end, high, low, strict=True)]


@dataclass
class Model:
    """Word scores, the law of chance segments, and the curve from evidence to probability."""

    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    level: float = 1.0
    curve: tuple[float, ...] = (-20.0, 0.0, 0.0)

    def found(self, text: bytes | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, all maximal segments)."""
        words = tokens(text)
        get = self.weights.get
        scores = np.fromiter((get(w, 0.0) for w in words), np.float64, len(words)) - DRIFT
        return len(words), segments(scores)

    def evidence(self, n: int, scores: Sequence[float]) -> tuple[float, float]:
        """(surprise of the best segment, sum over the significant ones)."""
        best = max(scores, default=0.0)
        if best <= 0:
            return 0.0, 0.0
        expected = self.level * n * np.exp(-self.rate * best)
        chance = -np.expm1(-expected)
        surprise = min(60.0, -np.log(max(chance, 1e-300)))
        over = [self.rate * s - np.log(self.level * n) for s in scores]
        least = -np.log(-np.log1p(-SIGNIFICANT))
        return surprise, float(np.log1p(sum(x for x in over if x >= least)))

    def significant(self, n: int, score: float) -> bool:
        return -np.expm1(-self.level * n * np.exp(-self.rate * score)) <= SIGNIFICANT

    def probability(self, evidence: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * evidence[0] + self.curve[2] * evidence[1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_odds(toxic: np.ndarray, clean: np.ndarray, every: np.ndarray, sizes: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, z-score) of words by their counts in toxic, clean and all texts.

    The z-score is the signed root of the log-likelihood ratio of the counts. It needs no word
    to occur in both classes: many toxic occurrences and no clean one are sure however rare the
    word is in the corpus.
    """
    n1, n0, n = sizes
    prior = PRIOR * np.maximum(every, 0.5) / max(n, 1.0)
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (n1 + PRIOR - a)) - np.log(b / (n0 + PRIOR - b))
    share = (toxic + clean) / max(n1 + n0, 1.0)
    ratio = sum(_gain(seen, size * p) for count, size in ((toxic, n1), (clean, n0)) for seen, p in ((count, share), (size - count, 1 - share)))
    return odds, np.sign(odds) * np.sqrt(np.maximum(2 * ratio, 0.0))


def _gain(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """seen * log(seen / expected), 0 where nothing is seen."""
    some = seen > 0
    return np.where(some, seen * np.log(np.where(some, seen, 1.0) / np.where(some, np.maximum(expected, 1e-300), 1.0)), 0.0)


def chance_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of "mean of exp(rate * score) is 1" for scores of negative mean."""
    if not (scores > 0).any() or (scores * shares).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    mean = lambda r: float((shares * np.exp(np.minimum(r * scores, 700))).sum())
    while mean(high) < 1 and high < 1e3:
        low, high = high, 2 * high
    low = max(low, 1e-6)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> tuple[float, ...]:
    """Intercept and coefficients by Newton steps; coefficients are never negative."""
    x = np.column_stack([np.ones(len(x)), x])
    free = np.ones(x.shape[1], bool)
    for _ in range(x.shape[1]):
        b = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            penalty = ridge * np.array([1e-6] + [1.0] * (len(b) - 1))
            gradient = x.T @ (y - p) - penalty * b
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
            step = np.zeros(len(b))
            step[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
            b += np.clip(step, -5, 5)
        wrong = (b < 0) & free & (np.arange(len(b)) > 0)
        if not wrong.any():
            break
        free &= ~wrong
    return tuple(float(v) for v in np.where(free, b, 0.0))


def held_out(id_: Column) -> Column:
    """Whether a row must not be learned from; FALSE for a NULL id, which has no label anyway."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _contexts(rows: DataFrame) -> DataFrame:
    """(word, n): how many different words stand before each word in the texts of ``rows`` (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[str, str]] = set()

        def listed() -> pa.RecordBatch:
            found = list(pairs)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.string()) for k in (0, 1)], ["word", "before"])

        for batch in batches:
            for t in batch.column(0):
                words = tokens(t.as_py())
                pairs.update(zip(words, ["", *words[:-1]], strict=True))
                if len(pairs) >= HELD_WORDS:
                    yield listed()
        yield listed()

    pairs = rows.select("t").mapInArrow(run, "word string, before string").distinct()
    return pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _counted(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, clean, toxic, other): counts per class over ``rows`` (t, kind) of the words ``asked`` (word).

    ``kind`` is -1 for texts of no class, the empty word stands for all words. A task counts every
    word and hands on its counts whenever they are of ``HELD_WORDS`` different words, so it holds
    no more, whatever the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (Counter(), Counter(), Counter())

        def counts() -> pa.RecordBatch:
            found = list(set().union(*kept))
            columns = [pa.array([c[w] for w in found], pa.int64()) for c in kept]
            for c in kept:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *columns], ["word", *_CLASSES])

        for batch in batches:
            for t, kind in zip(*batch.columns, strict=True):
                words = tokens(t.as_py())
                own = kept[kind.as_py()]
                own[""] += len(words)
                own.update(words)
                if sum(map(len, kept)) >= HELD_WORDS:
                    yield counts()
        yield counts()

    found = rows.select("t", "kind").mapInArrow(run, f"word string, {', '.join(f'{c} long' for c in _CLASSES)}")
    # The counts of a task hold most asked words once or more, so they meet after they are added up.
    # (Were they written first, Spark would turn that round where they are few.)
    found = found.groupBy("word").agg(*[F.sum(c).alias(c) for c in _CLASSES])
    return found.join(asked, "word", "left_semi")


def _telling(counts: DataFrame, sizes: tuple[float, float, float]) -> DataFrame:
    """(word, odds, clean, every): the words of ``counts`` whose log-odds are sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, toxic, other = (c.to_numpy().astype(float) for c in batch.columns[1:])
            every = clean + toxic + other
            odds, z = log_odds(toxic, clean, every, sizes)
            sure = np.abs(z) >= LEAST_Z
            columns = [pa.array(np.clip(odds, -4.0, 8.0)[sure]), pa.array(clean[sure]), pa.array(every[sure])]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(sure)), *columns], ["word", "odds", "clean", "every"])

    return counts.select("word", *_CLASSES).mapInArrow(run, "word string, odds double, clean double, every double")


def learned(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS,
    fit_rows: int = FIT_ROWS,
    max_terms: int | None = None,
) -> Model:
    """A model from the labelled rows that aren't held out.

    These rows bound the words it may hold; ``max_terms`` bounds them further, to those in most
    contexts of toxic texts.

    Rows with a NULL id or label teach nothing; of several labels of one id the largest counts.
    Without texts of both classes the model knows no words and every score is 0 or nearly so.
    """
    small_batches(docs.sparkSession)
    key = F.col(f"`{id_col}`")
    sample = labels.where(key.isNotNull() & F.col(f"`{label_col}`").isNotNull() & ~held_out(key))
    sample = sample.groupBy(key.alias("key")).agg((F.max(F.col(f"`{label_col}`")) > 0).cast("int").alias("kind"))
    # At most ``train_rows`` rows of two numbers: small enough to send everywhere.
    sample = sample.orderBy(F.xxhash64("key"), "key").limit(train_rows)
    sample = docs.sparkSession.createDataFrame(sample.collect(), "key long, kind int")
    texts = docs.select(key.cast("long").alias("key"), text_bytes(text_col).alias("t"))
    rows = texts.join(F.broadcast(sample), "key")
    frequent = _contexts(rows.where("kind > 0")).where(F.col("n") >= LEAST_CONTEXTS)
    if max_terms is not None:
        frequent = frequent.orderBy(F.desc("n"), "word").limit(max_terms)
    everything = texts.join(F.broadcast(sample), "key", "left").withColumn("kind", F.coalesce("kind", F.lit(-1)))
    asked = frequent.select("word").unionAll(docs.sparkSession.createDataFrame([("",)], "word string"))
    counts = staged(_counted(everything, asked), "toxicity-counts")
    total = counts.where("word = ''").first()
    clean_n, toxic_n, other_n = (float(total[c]) for c in _CLASSES) if total else (0.0, 0.0, 0.0)
    if not toxic_n or not clean_n:
        return Model()
    every_n = clean_n + toxic_n + other_n
    # Words of the labelled rows only, so these bound them.
    sure = _telling(counts.where("word != ''"), (toxic_n, clean_n, every_n)).orderBy("word").toArrow()
    if not len(sure):
        return Model()
    odds, clean, every = (sure.column(c).to_numpy() for c in ("odds", "clean", "every"))
    model = Model(dict(zip(sure.column("word").to_pylist(), odds.tolist(), strict=True)))
    prior = PRIOR * np.maximum(every, 0.5) / every_n
    shares = (clean + prior) / (clean_n + PRIOR)
    shares = np.append(shares, max(0.0, 1 - shares.sum()))
    model.rate = chance_rate(np.append(odds - DRIFT, -DRIFT), shares)
    few = docs.sparkSession.createDataFrame(sample.orderBy(F.xxhash64("key"), "key").limit(fit_rows).collect(), "key long, kind int")
    fitted = _segment_scores(texts.join(F.broadcast(few), "key"), model).collect()
    clean = [r for r in fitted if r.kind == 0 and r.n]
    chances = sum(r.n * np.exp(-model.rate * max(r.scores, default=0.0)) for r in clean)
    model.level = len(clean) / chances if chances else 1.0
    x = np.array([model.evidence(r.n, r.scores) for r in fitted])
    y = np.array([float(r.kind > 0) for r in fitted])
    if 0 < y.sum() < len(y):
        model.curve = logistic(x, y)
    return model


def _segment_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(kind, n, scores) per row of (t, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.found(t.as_py()) for t in batch.column(0)]
            scores = pa.array([[s for _, _, s in x] for _, x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in found], pa.int64()), scores], ["kind", "n", "scores"])

    return rows.select("t", "kind").mapInArrow(run, "kind int, n long, scores array<double>")


def _judge(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for t in batch.column(1):
                n, found = model.found(t.as_py())
                scores.append(model.probability(model.evidence(n, [s for _, _, s in found])))
                spans.append([{"start": a, "end": b, "score": s} for a, b, s in found if model.significant(n, s)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, passage)], ["id", "score", "passages"])

    return run


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **bounds: int
) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) for every row of ``docs``.

    ``passages`` holds (start, end, score) of each significant passage, in words. NULL and empty
    texts have none and get the score of no evidence. A NULL id is not held out. Rows of one id
    are scored each by its own text. Texts are judged whole. An empty table gives an empty one.
    Extra columns are ignored.
    """
    model = learned(docs, labels, id_col, text_col, label_col, **bounds)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("t"))
    judged = rows.mapInArrow(_judge(model), "id long, score double, passages array<struct<start:int,end:int,score:double>>")
    return judged.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "passages",
    )


def clean_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **bounds: int
) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; all columns as they are."""
    model = learned(docs, labels, id_col, text_col, label_col, **bounds)
    names = docs.columns

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = (model.found(t.as_py()) for t in batch)
            yield pa.array([model.probability(model.evidence(n, [s for _, _, s in x])) < 0.5 for n, x in found], pa.bool_())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    keep = F.arrow_udf(run, "boolean")
    return docs.where(keep(text_bytes(text_col))).select(*[F.col(f"`{c}`") for c in names])
