"""Running totals in a total order, without a one-task window.

Rows are range-partitioned into slices and written once (``operators/slices.py``); totals
run inside each slice, and the totals of whole slices before it are added. A key that holds
a third of the rows is cut into many slices, so no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.operators.slices import PLACE, SLICE, in_slices


def running_totals(
    df: DataFrame, order_by: Sequence[str | Column], totals: Sequence[str], by: str | None = None
) -> DataFrame:
    """``df`` with ``before_<name>`` for each of the ``totals``: the sum over the rows before it.

    Rows count as before in ``order_by`` order, inside their value of ``by`` if one is named
    (never NULL). Ties are taken in any order, but in one that holds for good: the slices are
    written. Sums are exact for integers.
    """
    sliced = in_slices(df, [*([by] if by else []), *order_by])
    keys = [*([by] if by else []), SLICE]
    whole = sliced.groupBy(*keys).agg(*[F.sum(c).alias(f"__whole_{c}") for c in totals])
    earlier = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice, and one more per further value of ``by`` that begins in it.
    offsets = whole.select(*keys, *[F.coalesce(F.sum(f"__whole_{c}").over(earlier), F.lit(0)).alias(f"__off_{c}") for c in totals])
    inside = Window.partitionBy(*keys).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{c}") for c in totals])
    joined = placed.join(offsets, keys)
    return joined.select(*df.columns, *[(F.col(f"__off_{c}") + F.col(f"__in_{c}")).alias(f"before_{c}") for c in totals])
