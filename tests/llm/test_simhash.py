import os

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablemill.llm import simhash
from tablemill.llm.components import components
from tests.llm.awkward import ROWS, as_rows, clashing, documents, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def plain(rows):
    """(id, hex fingerprint, component id) per row."""
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=repr)


def test_golay_code_is_perfect():
    words_ = np.arange(0, 1 << 23, 4099)
    index = simhash.golay_index(words_)
    assert index.min() >= 0 and index.max() < 4096
    # Turning up to three bits of a codeword leads back to it.
    base = 0
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                assert simhash.golay_index(np.array([base ^ (1 << a | 1 << b | 1 << c)]))[0] == 0


def test_two_bits_apart_share_a_key():
    draw = np.random.default_rng(3)
    fps = draw.integers(0, 1 << 63, 20, dtype=np.uint64)
    for fp in fps:
        own = set(simhash.fuzzy_keys(np.array([fp]))[1].tolist())
        assert 3 <= len(own) <= 18
        for a in range(64):
            for b in range(a, 64, 5):
                other = np.array([fp ^ np.uint64(1 << a) ^ np.uint64(1 << b if a != b else 0)])
                assert own & set(simhash.fuzzy_keys(other)[1].tolist())


@pytest.mark.parametrize("paired", [64, 2, 1])
def test_close_fingerprints_are_one_component(spark, paired):
    """Chains and a ball of very many fingerprints around one, by either way of linking."""
    draw = np.random.default_rng(5)
    centre = int(draw.integers(0, 1 << 62))
    fps = [centre ^ (1 << b) for b in range(0, 64)] + [int(x) for x in draw.integers(0, 1 << 62, 60)]
    chain = int(draw.integers(0, 1 << 62))
    for k in range(0, 20, 2):
        fps.append(chain)
        chain ^= 3 << k
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = components(simhash.linked_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), paired))
    got = {r.vertex: r.component for r in found.collect()}
    roots = plain_components([x & (2**64 - 1) for x in signed])
    for i, a in enumerate(signed):
        for j in range(i):
            same = got.get(a, a) == got.get(signed[j], signed[j])
            assert same == (roots[i] == roots[j])


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 8), (8, 7), (20, 20), (30, 31), (31, 30), (30, 31), (None, 5), (6, None)]
    got = as_rows(components(spark.createDataFrame(links, "x long, y long")))
    assert got == sorted([*[(i, 1) for i in range(1, 7)], (7, 7), (8, 7), (9, 7), (20, 20), (30, 30), (31, 30)], key=repr)
    assert as_rows(components(spark.createDataFrame([], "x long, y long"))) == []
    hub = [(i, 1000) for i in range(1, 400)]
    assert {c for _, c in as_rows(components(spark.createDataFrame(hub, "x long, y long")))} == {1}


def test_awkward_rows(spark):
    want = plain([(r[0], r[1]) for r in ROWS])
    assert as_rows(simhash.near_duplicates(documents(spark)), "doc_id", "fingerprint", "component_id") == want
    assert as_rows(simhash.near_duplicates(clashing(documents(spark)))) == want
    assert as_rows(simhash.near_duplicates(documents(spark, []))) == []


def test_keep_one(spark):
    docs = clashing(documents(spark))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = plain([(r[0], r[1]) for r in ROWS])
    heads = {c for _, _, c in found if c is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(heads)
    assert ids.count(None) == 2
    assert simhash.keep_one(documents(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert as_rows(simhash.near_duplicates(docs)) == plain(rows)
    cut = docs.withColumn("text", F.concat("text", F.lit(" end")))
    assert simhash.near_duplicates(docs.unionAll(cut)).count() == 2 * len(rows)
