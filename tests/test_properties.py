"""Properties over generated data, against plain Python models."""

import json

from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import rows
from tablemill.functions.jsontext import MASK, SENSITIVE_KEYS, json_masker
from tablemill.operators import sync as ops

pairs = st.lists(st.tuples(st.none() | st.integers(0, 5), st.sampled_from("abc")), max_size=12)


def by_row(found):
    return sorted(found, key=lambda r: [(v is not None, str(v)) for v in r])


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(pairs, pairs)
def test_sync_equals_its_model(spark, target, source):
    t = spark.createDataFrame(target, "k int, v string")
    s = spark.createDataFrame(source, "k int, v string")
    source_keys = {k for k, _ in source if k is not None}
    kept = [r for r in target if r[0] not in source_keys]
    out = ops.delete_insert(t, s, ["k"])
    assert rows(out) == by_row(kept + source)
    bounds = ops.key_bounds(s, ["k"])
    assert rows(ops.kept_rows(t, s, ["k"], bounds=bounds)) == by_row(kept)
    counts = ops.sync_counts(t, s, ["k"]).first()
    assert counts["rows_deleted"] == len(target) - len(kept)
    assert counts["rows_after"] == len(kept) + len(source)
    keyed = [r for r in source if r[0] is not None]
    again = spark.createDataFrame(keyed, "k int, v string")
    once = ops.delete_insert(t, again, ["k"])
    assert rows(ops.delete_insert(once, again, ["k"])) == rows(once)


keys = st.sampled_from(SENSITIVE_KEYS) | st.text(max_size=6)
nodes = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(keys, inner, max_size=4),
    max_leaves=20,
)
SENSITIVE = {k.lower() for k in SENSITIVE_KEYS}


def model(node):
    if isinstance(node, dict):
        return {k: MASK if k.lower() in SENSITIVE else model(v) for k, v in node.items()}
    return [model(v) for v in node] if isinstance(node, list) else node


@given(st.lists(nodes, max_size=3) | st.dictionaries(keys, nodes, max_size=4))
def test_masking_changes_only_sensitive_values(node):
    for text in (json.dumps(node), json.dumps(node, ensure_ascii=False, indent=1)):
        assert json.loads(json_masker()(text)) == model(node)


@given(st.text())
def test_masking_is_stable(text):
    once = json_masker()(text)
    assert json_masker()(once) == once
