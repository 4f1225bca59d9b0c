"""Periodic runs: against a search that tries every period at every place."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tablemill.llm.periods import periodic_runs, runs_and_rest
from tablemill.llm.queries import QUERIES
from tests.llm.awkward import as_rows, clashing, documents, words

FOLDER = "/root/testdata/sf0.001"


def plain_runs(w):
    """All runs of one sequence, smallest periods first."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smaller = any(s <= i and i + length <= s + n and q % p == 0 for s, n, p in found)
            if j > i and length >= max(6, 4 * q) and not smaller:
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_rest(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.lists(st.integers(0, 1), min_size=1, max_size=40), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=12))
def test_runs_of_small_alphabets(before, unit, times, after):
    w = before + unit * times + unit[: len(unit) // 2] + after
    assert [tuple(r) for r in periodic_runs(np.array(w, np.int64)).tolist()] == plain_runs(w)


@pytest.mark.parametrize("w, wanted", [([], []), ([7] * 5, []), ([7] * 6, [(0, 6, 1)]), ([1, 2] * 4, [(0, 8, 2)]), ([1, 2, 3] * 4 + [1], [(0, 13, 3)])])
def test_least_lengths(w, wanted):
    assert [tuple(r) for r in periodic_runs(np.array(w, np.int64)).tolist()] == wanted


def test_every_gram_of_a_period_recurs_within_it():
    """Seeds of five words alone would never meet at the period's own lag."""
    rng = np.random.default_rng(5)
    unit = rng.integers(0, 2, 300)
    w = np.concatenate([rng.integers(0, 2, 40), unit, unit, unit, unit, rng.integers(0, 2, 40)])
    found = [tuple(r) for r in periodic_runs(w).tolist()]
    assert found == plain_runs(w.tolist())
    assert any(p == 300 for _, _, p in found)


def test_a_million_equal_words():
    assert periodic_runs(np.zeros(1_000_000, np.int64)).tolist() == [[0, 1_000_000, 1]]


def test_awkward_rows(spark):
    extra = [(20, "x " * 40, "en", "a", 0), (21, "a b\tc\n" * 5 + "d", "en", "a", 0), (22, "x " * 3, "en", "a", 0)]
    from tests.llm.awkward import ROWS

    docs = clashing(documents(spark, ROWS + extra))
    wanted = []
    for doc_id, text, *_ in ROWS + extra:
        w = words(text)
        # The two long texts have no runs (test data); trying every period on them takes too long.
        found = plain_runs(w) if len(w) < 5000 else []
        wanted.append((doc_id, len(w), found, plain_rest(w, found)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in runs_and_rest(docs).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert any(r[2] for r in wanted)


def test_empty_table(spark):
    assert runs_and_rest(documents(spark).limit(0)).collect() == []


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    wanted = []
    for doc_id, text in texts.items():
        w = planted(doc_id, words(text))
        found = [tuple(r) for r in periodic_runs(np.unique(w, return_inverse=True)[1] if w else np.zeros(0)).tolist()]
        if len(w) < 3000:
            assert found == plain_runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, plain_rest(w, found))]
        start, length, period = best or (None, None, None)
        wanted.append((doc_id, len(found), start, length, period, best and 1000 * length // period, *digests))
    got = as_rows(QUERIES["op13_periodic"](spark, FOLDER))
    assert got == sorted(wanted, key=repr)
    assert sum(r[1] > 0 for r in wanted) > len(wanted) // 20
