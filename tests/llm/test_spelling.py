"""Spelling variants: against all pairs compared one by one."""

import random
import re
import zlib
from collections import Counter

import pytest

from tablemill.llm import spelling
from tablemill.llm.queries import QUERIES
from tests.llm.awkward import as_rows, clashing, documents

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
FOLD = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_near(words):
    """word -> its near words, by whole-word deletion keys: no chunks, no crowds."""
    spots = {}
    for w in words:
        for key in {(w, None)} | {(w[:i] + w[i + 1 :], i) for i in range(len(w))}:
            spots.setdefault(key[0], set()).add(w)
    near = {w: set() for w in words}
    for some in spots.values():
        for a in some:
            near[a] |= {b for b in some if one_edit(a, b)}
    return near


def plain(counts):
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near, forms = plain_near(counts), {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= 5 * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, len(near[w]), forms[w] and counts[forms[w]]))
    return sorted(rows, key=repr)


def variants_of(spark, counts, **bounds):
    rows = [(w,) for w, n in counts.items() for _ in range(n)]
    return as_rows(spelling.variants(spark.createDataFrame(rows, "word string"), **bounds), *COLUMNS)


def test_one_edit_by_brute_force():
    rng = random.Random(3)
    some = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(150)}
    near = plain_near(some)
    assert all((b in near[a]) == one_edit(a, b) for a in some for b in some)


@pytest.mark.parametrize("paired", [64, 3, 0])
def test_small_alphabet(spark, paired):
    """Every word has many near words; with few or no pairs allowed, all chunks are crowded."""
    rng = random.Random(paired)
    counts = {"".join(rng.choice("abü") for _ in range(rng.randint(5, 9))): rng.choice([4, 5, 6, 30, 160]) for _ in range(400)}
    assert variants_of(spark, counts, paired=paired) == plain(counts)


def test_a_stem_that_most_words_share(spark):
    rng = random.Random(1)
    stem = ["inter" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    ends = ["".join(rng.choice("abcdefgh") for _ in range(5)) + "ation" for _ in range(500)]
    counts = {w: rng.choice([5, 7, 26, 40]) for w in stem + ends}
    found = variants_of(spark, counts)
    assert found == plain(counts)
    assert sum(r[4] > 0 for r in found) > 50


def test_chains_and_ties(spark):
    counts = {"letter": 700, "lettar": 100, "lettarr": 12, "xettarr": 5, "abcdef": 5, "abcdeg": 25, "abcdeh": 25, "alone77": 9}
    found = {r[0]: r for r in variants_of(spark, counts)}
    assert found["xettarr"][1:3] == (None, "xettarr")  # 12 are fewer than five times 5
    assert found["lettarr"][1:3] == ("lettar", "letter")
    assert found["abcdef"][1] == "abcdeg"  # the first of equals
    assert sorted(found.values(), key=repr) == plain(counts)


def test_very_long_words(spark):
    long = "ab" * 30_000
    counts = {long: 30, long[:-1] + "x": 6, "y" + long: 5, long[1:]: 5, "z" + long + "z": 5}
    assert variants_of(spark, counts) == plain(counts)


def test_awkward_rows(spark):
    texts = ["Colour cOlour COLOUR colour colour, colour; colour colour colour colour"] * 3 + ["color1 color_ colourx colourx-colourx colourx colourx ÀÉÎõü× àéîõü÷"]
    rows = [(i, t, None, None, 0) for i, t in enumerate([*texts, None, "", " \n", "ß" * 9, "naïveté " * 5, "x" * 50_000])]
    counts = Counter(w for _, t, *_ in rows for w in re.findall(spelling.RUN, (t or "").translate(FOLD)))
    assert as_rows(spelling.spelling_variants(clashing(documents(spark, rows))), *COLUMNS) == plain(counts)
    assert as_rows(spelling.spelling_variants(documents(spark).limit(0))) == []
    assert as_rows(spelling.variants(spark.createDataFrame([(None,)] * 9, "word string"))) == []


def test_query(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall(spelling.RUN, r.text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    assert as_rows(QUERIES["op12_spelling"](spark, FOLDER), *COLUMNS) == plain(counts)
