import os
from collections import defaultdict


import pytest

from tablemill.llm import mixing, packing
from tests.llm.awkward import ROWS, as_rows, clashing, documents, words

FOLDER = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Shares by weight, capped again and again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget = share * sum(sizes.values())
    target, open_ = {}, set(names)
    while open_:
        left = budget - sum(target.values())
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > repeats * sizes[s]}
        if not over:
            return target | part
        target |= {s: float(repeats * sizes[s]) for s in over}
        open_ -= over
    return target


def test_targets_and_sizes(spark):
    found = mixing.mix(documents(spark)).collect()
    sizes = defaultdict(int)
    for _, text, _, source, _ in ROWS:
        sizes[source] += len(words(text))
    want = plain_targets(sizes)
    assert len(found) == len(ROWS)
    by_source = {}
    rows = {(r[0], len(words(r[1]))): r[3] for r in ROWS}
    for r in found:
        source = rows[r.doc_id, r["size"]]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r["size"]
        by_source[source] = by_source.get(source, 0) + r.taken
    biggest = max(len(words(r[1])) for r in ROWS)
    assert all(abs(by_source[s] - want[s]) <= biggest for s in want)
    assert sum(by_source.values()) <= 1.5 * sum(sizes.values())


def test_reruns_agree(spark):
    once, again = (as_rows(mixing.mix(documents(spark).repartition(n))) for n in (1, 5))
    assert once == again
    assert as_rows(mixing.mix(clashing(documents(spark)))) == once


def test_no_documents(spark):
    assert as_rows(mixing.mix(documents(spark, []))) == []
    assert mixing.mixed_rows(documents(spark, [])).count() == 0
    blank = documents(spark, [(1, None, None, None, None), (2, "", None, "a", 0)])
    assert as_rows(mixing.mix(blank)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mixed_rows_are_what_is_taken(spark):
    docs = clashing(documents(spark))
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix(docs).collect())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_sources_meet_their_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in mixing.mix(docs).collect():
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * most[s] for s in target)


def test_best_fit_by_search():
    """The bit searches against plain scans over all bins and all pieces to come."""
    import random

    draw = random.Random(4)
    cost = lambda c: 3 + c + c * c / 100
    for _ in range(30):
        caps = sorted(draw.sample(range(5, 60), 3))
        sizes = sorted((draw.randint(1, caps[-1]) for _ in range(60)), reverse=True)
        which, place, capacity = packing.best_fit(sizes, caps, 3, 100)
        opened, filled = [], []

        def per_word(c, k):
            fill = sizes[k]
            for s in sizes[k + 1 :]:
                fill += s if fill + s <= c else 0
            return cost(min(x for x in caps if x >= fill)) / fill

        for k, (size, b) in enumerate(zip(sizes, which, strict=True)):
            room = sorted((opened[k] - filled[k], k) for k in range(len(opened)) if opened[k] - filled[k] >= size)
            if room:
                assert opened[b] - filled[b] == room[0][0]
            else:
                assert b == len(opened)
                opened.append(min((c for c in caps if c >= size), key=lambda c: (per_word(c, k), c)))
                filled.append(0)
            filled[b] += size
        assert capacity == [min(c for c in caps if c >= f) for f in filled]


def least_cost(sizes, caps, *weights):
    """The least cost of any way to put ``sizes`` into sequences, over all subsets."""
    full = (1 << len(sizes)) - 1
    total = [sum(s for k, s in enumerate(sizes) if m >> k & 1) for m in range(full + 1)]
    one = [min((packing.sequence_cost(c, *weights) for c in caps if c >= t), default=float("inf")) for t in total]
    best = [0.0] + [float("inf")] * full
    for m in range(1, full + 1):
        first = m & -m
        part = m ^ first
        while True:
            best[m] = min(best[m], one[part | first] + best[m ^ part ^ first])
            if not part:
                break
            part = (part - 1) & (m ^ first)
    return best[full]


def test_cost_is_near_the_least():
    import random

    draw, ratios = random.Random(9), []
    caps = (8, 16, 32, 64)
    for _ in range(120):
        sizes = sorted((draw.randint(1, draw.choice((8, 30, 64))) for _ in range(draw.randint(1, 8))), reverse=True)
        weights = (1, draw.choice((64, 128, 256)))
        got = sum(packing.sequence_cost(c, *weights) for c in packing.best_fit(sizes, caps, *weights)[2])
        ratios.append(got / least_cost(sizes, caps, *weights))
    assert max(ratios) < 1.2 and sum(ratios) / len(ratios) < 1.01


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_several_lengths_cost_less_than_the_one_that_holds_all(spark):
    rows = packing.packing(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("n_words > 0").collect()
    bins = {r.bin_id: r.capacity for r in rows}
    counts = {c: sum(x == c for x in bins.values()) for c in packing.CAPACITIES}
    assert all(counts.values())
    alone = packing.best_fit(sorted((r.n_words for r in rows), reverse=True), (4096,))[2]
    assert sum(map(packing.sequence_cost, bins.values())) < 0.9 * sum(map(packing.sequence_cost, alone))


def check_layout(rows, caps, sizes):
    """Every word once, bins in one piece, none over its capacity, each as short as can be."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.piece, r.start, r.n_words))
        if r.n_words:
            bins[r.bin_id].append((r.place, r.n_words, r.capacity))
        else:
            assert r.bin_id is None and r.capacity is None
    for inside in bins.values():
        at = 0
        for place, n, _ in sorted(inside):
            assert place == at
            at += n
        assert {c for _, _, c in inside} == {min(c for c in caps if c >= at)}
    assert sum(n for r in docs.values() for _, _, n in r) == sum(sizes)
    assert max((n for r in docs.values() for _, _, n in r), default=0) <= max(caps)


@pytest.mark.parametrize("caps", [(512, 1024, 2048, 4096), (7, 16), (1,)])
def test_packing(spark, caps):
    few = [r for r in ROWS if caps != (1,) or len(r[1] or "") < 100]
    rows = packing.packing(clashing(documents(spark, few)), capacities=caps).collect()
    check_layout(rows, caps, [len(words(r[1])) for r in few])


def test_small_shards(spark):
    rows = packing.packing(documents(spark), capacities=(16, 64), shard_pieces=50).collect()
    check_layout(rows, (16, 64), [len(words(r[1])) for r in ROWS])


def test_no_rows_to_pack(spark):
    assert packing.packing(documents(spark, [])).count() == 0
    assert packing.packed_texts(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.packing(documents(spark), capacities=())


@pytest.mark.parametrize("stored", [False, True])
def test_pieces_give_the_text_back(spark, tmp_path, stored):
    docs = clashing(documents(spark))
    if stored:
        docs.repartition(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = packing.packed_texts(docs, capacities=(100, 1000), stored=stored).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append((r.start, r.text))
    for id_ in (1, 6, 7, 8, 12, 13):
        text = next(t for i, t, *_ in ROWS if i == id_)
        assert "".join(t for _, t in sorted(texts[id_])) == text
        assert all(len(words(t)) <= 1000 for _, t in texts[id_])
    check_layout(rows, (100, 1000), [len(words(r[1])) for r in ROWS])
