"""Connected components over a frame of links, by alternating star contractions.

Each round is joins and partial aggregations over the links, written to the shared
folder; the driver sees two numbers a round. A vertex with very many links is only ever
the key of a pre-aggregated minimum and of a join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablemill.llm.common import release
from tablemill.session import delete_path, work_path


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema("a long, b long").parquet(path), path


def _state(links: DataFrame) -> tuple[int, int]:
    """Count and an order-free digest of the links."""
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    row = links.agg(F.count(F.lit(1)), digest).first()
    return row[0], row[1] or 0


def _large_star(links: DataFrame) -> tuple[DataFrame, str]:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, path = _write(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b")), "star-least"
    )
    least = least.select(F.col("a").alias("v"), F.col("b").alias("m"))
    far = both.where("b > a").join(least, F.col("a") == F.col("v"))
    return far.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"), path


def _small_star(links: DataFrame) -> tuple[DataFrame, str]:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least, path = _write(down.groupBy("a").agg(F.min("b").alias("b")), "star-least")
    to = least.select(F.col("a").alias("v"), F.col("b").alias("m"))
    near = down.join(to, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.where("a != b").unionAll(least), path


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``links`` (a, b): the least vertex it reaches.

    ``links`` holds two integer columns; order, repeats and loops don't matter, rows with a
    NULL are no link. A vertex with only a loop is its own component. Takes a number of rounds
    that grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    links = links.toDF("a", "b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    given, given_path = _write(links.where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    now, now_path = _write(given.where("a != b"), "stars")
    state = _state(now)
    before = None
    while state != before and state[0]:
        large, p1 = _large_star(now)
        mid, mid_path = _write(large.distinct(), "stars")
        small, p2 = _small_star(mid)
        after, after_path = _write(small.distinct(), "stars")
        for path in (now_path, mid_path, p1, p2):
            delete_path(spark, path)
        now, now_path, before, state = after, after_path, state, _state(after)
    release(spark)
    roots = now.select(F.col("b").alias("a"), "b").distinct()
    alone = given.where("a = b").join(now.select("a"), "a", "left_anti")
    alone = alone.join(now.select(F.col("b").alias("a")), "a", "left_anti")
    found = now.unionAll(roots).unionAll(alone.select("a", "b"))
    return found.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
