"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow that serves its documents in a shuffled order, again and again up to
``repeats`` times. A document's virtual finish time is the words its source has served up to
and with it, divided by the source's target, so a source that has met its target stands at
time 1. All documents are sorted by that time over all sources, and the mix ends where the
total budget is used up. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablemill.llm.common import WORD, free
from tablemill.llm.running import running_totals
from tablemill.operators.slices import dense_ids
from tablemill.session import staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
_ROWS = ("row", "id", "source", "size")


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> tuple[DataFrame, float]:
    """(key, source_size, target) per source of ``sizes`` (key, source, size), and the total budget.

    The budget is ``share`` times all sizes. Sources by code point, NULL last, take the weights
    in turn. No target exceeds ``repeats`` times its source's size; what is over goes to the
    others by weight. Sources sorted by (most they can give / weight) fill up in that order, so
    the level all others reach follows from two running totals.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    ranked = dense_ids(per, "rank", [F.col("source").asc_nulls_last()], start=0)
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    flows = ranked.select("key", "source_size", turn.cast("long").alias("weight"), (F.col("source_size") * repeats).alias("most"))
    flows = staged(flows, "flows")
    words, parts = flows.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = float(share * (words or 0))
    full = F.col("most") / F.col("weight")
    filled = staged(running_totals(flows, [full, "key"], ["most", "weight"]), "flows-filled")
    level = (F.lit(budget) - F.col("before_most")) / (F.lit(float(parts or 0)) - F.col("before_weight"))
    reached = filled.where(full >= level).agg(F.max(level)).first()[0]
    fair = F.col("weight") * F.lit(reached) if reached is not None else F.col("most")
    out = filled.select("key", "source_size", F.least(F.col("most").cast("double"), fair.cast("double")).alias("target"))
    return staged(out, "flow-targets"), budget


def _mixed(
    rows: DataFrame, seed: str, weights: Sequence[int], share: float, repeats: int
) -> DataFrame:
    """``rows`` (row, id, source, size) with source_size, target and how often each is taken."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sizes = rows.select("row", "id", "size", key.alias("key"), "source")
    goal, budget = targets(sizes, weights, share, repeats)
    lap = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("lap")
    queued = sizes.drop("source").join(goal, "key").select("*", lap)
    # Laps that begin beyond the target can't be served; the first stays, so that no row is lost.
    queued = queued.where((F.col("lap") == 1) | ((F.col("lap") - 1) * F.col("source_size") < F.col("target")))
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col("lap").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    served = running_totals(queued.withColumn("draw", shuffled), ["lap", "draw", "size", "row"], ["size"], by="key")
    # NULL where the target is 0: such a source has no words.
    finish = (F.col("before_size") + F.col("size")) / F.when(F.col("target") > 0, F.col("target"))
    served = served.select("row", "id", "size", "source_size", "target", "draw", finish.alias("finish"))
    line = running_totals(served, [F.col("finish").asc_nulls_last(), "draw", "size", "row"], ["size"])
    fits = (F.col("before_size") + F.col("size") <= F.lit(budget)) & F.col("finish").isNotNull()
    return line.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("id", "size", "source_size", "target")],
        F.sum(fits.cast("long")).alias("copies"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    ``size`` counts words (NULL and empty texts: 0), ``taken`` is the size times the laps in
    which the mix takes the document: 0 to ``repeats``. Documents are taken whole; the mix stops
    before the first that goes over the budget. A NULL source is a source of its own, after all
    others; a NULL id is shuffled like an empty one. Rows of one id are documents of their own.
    The order depends on seed, lap and id only, so reruns agree. An empty table gives an empty
    one. Extra columns are ignored.
    """
    found = _mixed(_sized(docs, id_col, text_col, source_col), seed, weights, share, repeats)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
    )
    return staged(rows, "mix-sizes")


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as the mix takes it.

    Documents without words are in no mix. Otherwise as ``mix``.
    """
    names = docs.columns
    row, copies = free(names, "__row"), free(names, "__copies")
    kept = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    sized = kept.select(
        F.col(row).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
    )
    found = _mixed(staged(sized, "mix-sizes"), seed, weights, share, repeats)
    taken = found.where("copies > 0 AND size > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(copies))
    out = kept.join(taken, row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*[F.col(f"`{c}`") for c in names])
