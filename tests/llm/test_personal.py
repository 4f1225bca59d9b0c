import os
import re

import pytest
from hypothesis import given, settings, strategies as st

from tablemill.llm import personal
from tests.llm.awkward import LONG, ROWS, as_rows, clashing, documents

FOLDER = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        n = int(c) * (2 if k % 2 else 1)
        total += n if n < 10 else n - 9
    return total % 10 == 0


def plain(text):
    """(start, kind, end) by the expressions as they are written down."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.+-@ ()aZ%_ü\n", max_size=60))
def test_seeds(text):
    assert personal.seeds(text) == plain(text)


def test_seeds_of_very_long_runs():
    """Runs on which plain backtracking would take hours."""
    n = 200_000
    assert personal.seeds("a" * n + "@") == []
    assert personal.seeds("7" * n) == []
    assert len(personal.seeds("1." * n)) == n // 4
    assert personal.seeds("x" * n + "@example.com") == [(0, 0, n + 12)]
    assert personal.seeds("+1 " * n) == []


def test_candidates_of_very_long_runs():
    import time

    began, n = time.time(), 3_000_000
    assert list(personal._candidates("7" * n, [])) == [(0, n)]
    assert list(personal._candidates("x " + "7" * n + " 77", [])) == [(2, n + 2)]
    assert not list(personal._grouped("7 " * (n // 10), 0, n))
    assert time.time() - began < 30


def test_what_stands_beside_a_seed_is_a_candidate():
    """The phone's form swallows the address behind it and fails; what is left of it is still there."""
    text = "reach +1 (826) 555-4081 190.137.2.9 today"
    known = personal.seeds(text)
    assert [text[s:e] for s, _, e in known] == ["190.137.2.9"]
    assert [text[s:e] for s, e in personal._candidates(text, known)] == ["+1 (826) 555-4081"]


def test_awkward_rows(spark):
    got = {}
    for r in personal.personal_data(clashing(documents(spark))).collect():
        got.setdefault(r.doc_id, []).append([tuple(s) for s in r.base])
    want = {}
    for i, text, *_ in ROWS:
        want.setdefault(i, []).append(plain(text or ""))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert personal.personal_data(documents(spark, [])).count() == 0


def learnable():
    """Phones of known form in a context, and others that only the context tells."""
    rows = [(i, f"please call me at +1 (2{i:02d}) 555-0{i:03d} tomorrow about it {i}", "en", "s", 0) for i in range(40)]
    rows += [(100 + i, f"please call me at 0{i:02d}/4455{i:02d} tomorrow or never", "en", "s", 0) for i in range(5)]
    return rows + [(200, "the order 017/445599 has come", "en", "s", 0), (201, "again 001/445501, in plain sight", "en", "s", 0)]


def test_contexts_find_unseen_identifiers(spark):
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in personal.personal_data(documents(spark, learnable())).collect()}
    for i in range(5):
        assert found[100 + i] == [(18, 3, 28)]
    assert found[200] == []
    assert found[201] == [(6, 3, 16)]
    assert all(len(found[i]) == 1 for i in range(40))


def test_without_rounds_only_known_forms(spark):
    found = personal.personal_data(documents(spark, learnable()), rounds=0).collect()
    assert all(r.base == r.spans for r in found)


def test_scores_need_support_and_confidence(spark):
    edges = [("p", f"seed{i}", 3) for i in range(20)] + [("p", "new", None), ("q", "seed1", 3), ("q", "other", None)]
    edges += [("mixed", f"seed{i}", 3) for i in range(20)] + [("mixed", f"x{i}", None) for i in range(20)]
    found = personal.scored(spark.createDataFrame(edges, "pattern string, value string, kind int"))
    assert [(r.value, r.kind) for r in found.collect()] == [("new", 3)]


def test_redacted(spark):
    docs = clashing(documents(spark))
    out = personal.redacted(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[11] == "mail me at [EMAIL] or [PHONE], host [IP], card [CARD]"
    assert texts[3] is None and texts[4] == "" and texts[6] == LONG
    for i in (1, 12):
        assert texts[i] == next(t for j, t, *_ in ROWS if j == i)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    found = personal.personal_data(docs).collect()
    assert len(found) == len(text)
    for r in found:
        assert [tuple(s) for s in r.base] == plain(text[r.doc_id])
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    masked = {r.doc_id: r.text or "" for r in personal.redacted(docs).select("doc_id", "text").collect()}
    assert not any(plain(t) for t in masked.values())


def test_rows_in_any_layout(spark):
    one, many = (as_rows(personal.personal_data(documents(spark).repartition(n))) for n in (1, 4))
    assert one == many


def test_common_numbers_count_by_their_places(spark):
    """A year in a trusted pattern is a phone there and a year elsewhere; so is a date that stands mostly elsewhere."""
    rows = [(i, f"please call me at +1 (2{i:02d}) 555-0{i:03d} tomorrow about it {i}", "en", "s", 0) for i in range(30)]
    rows += [(100, "please call me at 2020 tomorrow or never", "en", "s", 0), (101, "it was 2020 when we met", "en", "s", 0)]
    rows += [(110, "please call me at 2021-01-17 tomorrow or never", "en", "s", 0)]
    rows += [(120 + i, f"we met on 2021-01-17 in town {chr(97 + i)}", "en", "s", 0) for i in range(9)]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in personal.personal_data(documents(spark, rows)).collect()}
    assert found[100] == [(18, 3, 22)] and found[110] == [(18, 3, 28)]
    assert found[101] == [] and not any(found[120 + i] for i in range(9))
    texts = {r.doc_id: r.text for r in personal.redacted(documents(spark, rows)).collect()}
    assert texts[101] == rows[31][1] and texts[100] == "please call me at [PHONE] tomorrow or never"


def test_digit_groups_are_one_candidate():
    listed = lambda text: sorted(text[s:e] for s, e in personal._candidates(text, personal.seeds(text)))
    assert listed("call me at (555) 123-4567 or 01 23 45 67 89, now") == ["(555) 123-4567", "01 23 45 67 89"]
    assert listed("card 4111 1111 1111 1112. It") == ["4111 1111 1111 1112"]
    assert listed("(555 123 4567), 555.123.4567") == ["555 123 4567", "555.123.4567"]
    assert listed("in 1999. 2020 was AB-12345 6789 017/445599") == ["017/445599", "1999", "2020", "6789", "AB-12345"]
    assert listed("+1 (202) 555-0199 host 10.0.0.1") == []
    assert listed("1 2 3 4 5 6 7") == []
    assert len(listed("12 " * 100_000)) == 0


def test_phones_with_blanks_are_found_whole(spark):
    rows = [(i, f"please call me at +1 (2{i:02d}) 555-0{i:03d} tomorrow about it {i}", "en", "s", 0) for i in range(40)]
    rows += [(100, "please call me at (555) 123-4567 tomorrow", "en", "s", 0), (101, "please call me at 030 1234 567 tomorrow", "en", "s", 0)]
    texts = {r.doc_id: r.text for r in personal.redacted(documents(spark, rows)).collect()}
    assert texts[100] == texts[101] == "please call me at [PHONE] tomorrow"


def test_rounds_go_on_until_nothing_is_new(spark):
    """Each level's strings make the patterns that find the next level's."""
    level = lambda k: [(f"level{k}x{i:02d}-5555555", 3 if k == 0 else None) for i in range(12)]
    edges = []
    for k in range(6):
        for i, (new, _) in enumerate(level(k + 1)):
            for p in "pq":
                edges += [(f"{p}{k} {i} _", old, kind, 1) for old, kind in level(k)] + [(f"{p}{k} {i} _", new, None, 100)]
    found = personal.scored(spark.createDataFrame(edges, "pattern string, value string, kind int, n int")).collect()
    assert {r.value for r in found} == {v for k in range(1, 7) for v, _ in level(k)}
