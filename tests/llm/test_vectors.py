import math
import os
from collections import Counter

import numpy as np
import pytest

from tablemill.llm import balltree, kmeanstree
from tests.llm.awkward import as_rows, clashing

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def good(rows, nonzero=False):
    """(id, vector) of the rows that take part."""
    out = []
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or (nonzero and not any(v)):
            continue
        out.append((i, [float(np.float32(x)) for x in v]))
    return out


def plain_exact(rows, k=20, every=20):
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in good(rows)]
    out = []
    for n, (q, asked) in enumerate(ints):
        if q % every:
            continue
        others = [(i, v) for m, (i, v) in enumerate(ints) if m != n and len(v) == len(asked)]
        scored = sorted((-sum(a * b for a, b in zip(asked, v, strict=True)), i) for i, v in others)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], start=1)]
    return sorted(out, key=repr)


def random_rows(n, d=6, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, draw.normal(size=d).tolist(), 0) for i in range(n)]


AWKWARD = [
    *random_rows(150),
    *[(1000 + i, [1.0] * 6, 0) for i in range(90)],  # one vector many times: ties all over
    (2000, None, 0),
    (2020, [], 0),
    (2040, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0),
    (2060, [float("nan")] * 6, 0),
    (2080, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 0),
    (2100, [0.0] * 6, 0),
    (None, [1.0] * 6, 0),
    (20, [9.0] * 6, 0),  # an id that is there already
    (20, [9.0] * 6, 0),  # and the whole row once more
    (21, [1.0] * 6, 0),
    *[(3000 + 5 * i, [i - 9.0, 2.0, 0.5], 0) for i in range(40)],  # another dimension
    (3000, [7.0, 7.0, 7.0], 0),
    (4000, [5.0, 5.0], 0),  # a query without candidates
    (4001, [5.0], 0),  # a candidate without queries
    (-40, [0.001] * 6, 0),
    (2120, [300.0, -300.0, 5.0, 0.0, 1.0, 2.0], 0),
]


@pytest.mark.parametrize("shard_rows", [4096, 32])
def test_exact_top_k(spark, shard_rows):
    df = clashing(spark.createDataFrame(AWKWARD, SCHEMA))
    assert as_rows(balltree.top_k(df, shard_rows=shard_rows)) == plain_exact(AWKWARD)


def test_few_or_no_rows(spark):
    few = random_rows(5)
    assert as_rows(balltree.top_k(spark.createDataFrame(few, SCHEMA))) == plain_exact(few)
    for rows in ([], [(20, [1.0], 0)], [(7, [1.0], 0)], [(20, None, 0)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert balltree.top_k(df).count() == kmeanstree.neighbours(df).count() == 0


def test_large_products_are_exact(spark):
    rows = [(i, [2.0**22 + i, -(2.0**19) * i, 1.0], 0) for i in range(41)]
    assert as_rows(balltree.top_k(spark.createDataFrame(rows, SCHEMA))) == plain_exact(rows)


def test_tree_bounds_hold():
    draw = np.random.default_rng(0)
    points = draw.integers(-90, 90, (700, 5)).astype(float)
    tree = balltree.build(np.arange(700), points, 16)
    for (s, e), c, r in zip(tree["spans"], tree["centres"], tree["radii"], strict=True):
        assert (np.sqrt(((tree["points"][s:e] - c) ** 2).sum(axis=1)) <= r + 1e-9).all()
    leaves = [tuple(s) for s, c in zip(tree["spans"].tolist(), tree["child"], strict=True) if not c]
    assert sorted(leaves)[0][0] == 0 and sum(e - s for s, e in leaves) == 700


def test_bounds_save_visits():
    """Of tight groups far apart only those near a query are looked into."""
    draw = np.random.default_rng(2)
    points = np.repeat(draw.integers(-500, 500, (40, 8)), 50, axis=0) + draw.integers(-2, 3, (2000, 8))
    tree = balltree.build(np.arange(2000), points.astype(float), 64)

    class Counted(np.ndarray):
        looked = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.looked += at.stop - at.start
            return np.asarray(self)[at]

    tree["points"] = tree["points"].view(Counted)
    balltree.search(tree, np.array([-1]), points[:1].astype(float), np.array([-np.inf]), 20)
    assert Counted.looked < 600


def plain_near(rows, k=20, every=20):
    """Per query id a list for each of its rows: their true neighbours and scores."""
    vectors = good(rows, nonzero=True)
    out = {}
    for n, (q, asked) in enumerate(vectors):
        if q % every:
            continue
        others = [(i, v) for m, (i, v) in enumerate(vectors) if m != n and len(v) == len(asked)]
        scored = sorted((-sum(a * b for a, b in zip(asked, v, strict=True)), i) for i, v in others)
        if scored:
            out.setdefault(q, []).append([(i, -s) for s, i in scored[:k]])
    return out


@pytest.mark.parametrize("shard_rows", [4096, 16])
def test_near_neighbours(spark, shard_rows):
    df = clashing(spark.createDataFrame(AWKWARD, SCHEMA))
    got = {}
    for r in kmeanstree.neighbours(df, leaf_rows=8, shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain_near(AWKWARD)
    assert set(got) == set(want)
    hits = asked = 0
    for q, found in got.items():
        # As many answers as rows of that id, each with ranks of its own.
        ranks = sorted(r for _ in want[q] for r in range(1, len(want[q][0]) + 1))
        assert sorted(r for r, _, _ in found) == ranks
        for rank in set(ranks):
            assert len([r for r, _, _ in found if r == rank]) == len(want[q])
        if len(want[q]) == 1:
            found.sort()
            assert all((-a[2], a[1]) < (-b[2], b[1]) or a[1:] == b[1:] for a, b in zip(found, found[1:], strict=False))
        true = [x for answer in want[q] for x in answer]
        for _, i, s in found:
            products = [sum(a * b for a, b in zip(v, w, strict=True)) for n, (p, v) in enumerate(good(AWKWARD, nonzero=True)) if p == q
                        for m, (c, w) in enumerate(good(AWKWARD, nonzero=True)) if c == i and m != n and len(v) == len(w)]
            assert any(s == pytest.approx(p, abs=1e-9) for p in products)
        hits += sum((Counter(i for _, i, _ in found) & Counter(i for i, _ in true)).values())
        asked += len(true)
    assert hits >= 0.9 * asked


def test_rows_of_one_id_and_other_dimensions_stay(spark):
    rows = [(20, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (20, [0.0, 1.0], 0), (7, [3.0, 1.0], 0), (40, [1.0, 1.0, 1.0], 0), (41, [2.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_rows(balltree.top_k(df)) == plain_exact(rows)
    near = kmeanstree.neighbours(df)
    assert sorted(tuple(r) for r in near.collect()) == sorted(
        (q, rank, i, s) for q, answers in plain_near(rows).items() for answer in answers for rank, (i, s) in enumerate(answer, start=1)
    )


def test_few_candidates_all_come(spark):
    few = random_rows(30)
    found = kmeanstree.neighbours(spark.createDataFrame(few, SCHEMA), k=50, leaf_rows=4, recall=0.01).collect()
    assert len(found) == 2 * 29


def test_best_bins_come_in_turn():
    points = np.random.default_rng(1).normal(size=(500, 4))
    tree = kmeanstree.Tree(points, 10.0)
    leaf = tree.leaf_of(points)
    assert set(leaf) == set(range(tree.leaves))
    for v, order in zip(points[:20], tree.visits(points[:20]), strict=True):
        order = list(order)
        assert sorted(order) == list(range(tree.leaves))
        assert order[0] == tree.leaf_of(v[None])[0]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_recall_on_given_vectors(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    want = {q: answers[0] for q, answers in plain_near([(r.vec_id, r.embedding, 0) for r in df.collect()]).items()}
    got = {}
    for r in kmeanstree.neighbours(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)
