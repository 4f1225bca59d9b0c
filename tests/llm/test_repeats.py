import os
import random

import pytest

from tablemill.llm import repeats
from tests.llm.awkward import PASSAGE, ROWS, as_rows, clashing, documents, words

FOLDER = "/root/testdata/sf0.001"


def plain(rows, passage):
    """(id, words, removed words, kept text) by comparing every window."""
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - passage + 1) if i is not None else ():
            window = " ".join(w[k : k + passage])
            first[window] = min(i, first.get(window, i))
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - passage + 1) if i is not None else ():
            if first[" ".join(w[k : k + passage])] < i:
                gone[k : k + passage] = [True] * passage
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_cover():
    assert repeats.covers(repeats.COVER, repeats.PERIOD)
    assert not repeats.covers((0, 1, 2), 31)


@pytest.mark.parametrize("shift", range(31))
def test_any_shift_shares_an_anchor(shift):
    """A passage at two places of its documents, whatever the places."""
    passage = [b"p%d" % k for k in range(50)]
    width = repeats.PASSAGE - repeats.PERIOD + 1
    found = []
    for before in (3, 3 + shift):
        w = [b"x%d" % (before * 100 + k) for k in range(before)] + passage + [b"y"] * 7
        starts = repeats.anchor_starts(len(w), width)
        inside = starts[(starts >= before) & (starts + width <= before + 50)]
        found.append(set(repeats.Windows(repeats.word_hashes(w), repeats._B1).at(inside, width).tolist()))
    assert found[0] & found[1]


def test_awkward_rows(spark):
    want = plain([(r[0], r[1]) for r in ROWS], repeats.PASSAGE)
    assert as_rows(repeats.without_repeats(documents(spark))) == want
    assert sum(r[2] for r in want) > 60_000
    assert as_rows(repeats.without_repeats(clashing(documents(spark)))) == want
    assert as_rows(repeats.without_repeats(documents(spark, []))) == []


def test_random_texts(spark):
    """Few words, short passages: overlaps, repeats inside a text, passages at either end."""
    draw = random.Random(11)
    stock = [[f"w{draw.randrange(6)}" for _ in range(draw.randint(5, 30))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [w for _ in range(draw.randint(1, 4)) for w in draw.choice(stock)]
        rows.append((i, " ".join(parts), "en", "s", 0))
    got = repeats.without_repeats(documents(spark, rows), passage=12, period=7, cover=(0, 1, 3))
    assert as_rows(got) == plain([(r[0], r[1]) for r in rows], 12)


def test_texts_of_one_id_are_told_apart(spark):
    rows = [(1, PASSAGE, "", "", 0), (5, f"a b c {PASSAGE}", "", "", 0), (5, f"{PASSAGE} d e", "", "", 0), (5, "short", "", "", 0)]
    assert as_rows(repeats.without_repeats(documents(spark, rows))) == plain([(r[0], r[1]) for r in rows], 50)


def test_bad_cover(spark):
    with pytest.raises(ValueError):
        repeats.repeated_windows(spark.createDataFrame([], "id long, t binary"), 50, 31, (0, 1))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows, 50)
    assert sum(r[2] for r in want) > 0
    assert as_rows(repeats.without_repeats(docs)) == want
