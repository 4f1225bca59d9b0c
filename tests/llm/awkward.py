"""Rows that operators must survive, and plain versions of what they compute."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for themselves, as columns of the input.
CLASHES = ("row", "id", "t", "fp", "size", "key", "kind", "start", "rank", "copies", "__row", "__rank", "__first", "__spans", "SCORE")

LONG = " ".join(f"wörd{i % 977} filler{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 36),
    (2, "alpha BETA gamma delta epsilon zeta.", "en", "a", 36),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (6, LONG, "de", None, len(LONG)),
    (7, LONG, "de", "c", len(LONG)),
    (8, f"before {PASSAGE} after", "en", "c", 9),
    (9, f"{PASSAGE} and more words behind it", "en", "", 9),
    (10, "one", "en", "a", 3),
    (10, "one", "en", "a", 3),
    (10, f"another text of the same id {PASSAGE}", "en", "a", 3),
    (None, f"a row without an id {PASSAGE}", "en", "a", 3),
    (None, "a row without an id", "en", "a", 3),
    (11, "mail me at jane.doe@example.com or +1 (234) 567-8901, host 10.0.0.1, card 4111 1111 1111 1111", "en", "d", 9),
    (12, "quote \" back\\slash 'single' üñí 😀 line\nbreak", "fr", "d", 9),
    (13, "@@@@ ++++ .... 1.1.1.1.1.1.1 999.999.999.999 a@b a@b.c x@y.z@u.v 0000000000000000", "en", "d", 9),
]


def documents(spark: SparkSession, rows=ROWS) -> DataFrame:
    return spark.createDataFrame(rows, DOCS)


def clashing(df: DataFrame) -> DataFrame:
    """The same rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    taken = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES) if c.lower() not in taken])


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def as_rows(df: DataFrame, *columns: str) -> list[tuple]:
    got = df.select(*[f"`{c}`" for c in columns]) if columns else df
    return sorted((tuple(r) for r in got.collect()), key=repr)
