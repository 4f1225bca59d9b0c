"""The registered queries: against their SQL, and against plain versions where there is none."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tablemill.llm import mixing, personal, toxicity
from tablemill.llm.queries import ORACLES, QUERIES
from tests.llm.awkward import clashing, documents, words
from tests.llm.test_mixing_and_packing import check_layout
from tests.llm.test_simhash import plain as plain_near_duplicates

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_all_and_the_pipeline_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    wanted = duck.sql(ORACLES[name])
    assert sorted(wanted.columns) == columns
    order = [wanted.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in wanted.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


@pytest.mark.parametrize(
    "name, schema",
    [
        ("op3_toxicity", "doc_id bigint, held_out boolean, score double, predicted int"),
        ("op5_packing", "doc_id bigint, piece int, start bigint, n_words bigint, bin_id bigint, capacity bigint"),
        ("op6_ann", "query_id bigint, rank int, vec_id bigint, score double"),
        ("op7_substrings", "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"),
        ("op8_simhash", "doc_id bigint, fingerprint string, component_id bigint"),
        ("op9_warc", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"),
        ("op11_token_planes", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"),
        ("op12_spelling", "word string, form string, root string, n bigint, n_near bigint, form_n bigint"),
        ("op13_periodic", "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"),
        ("op10_pii", "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"),
    ],
)
def test_columns(spark, name, schema):
    df = QUERIES[name](spark, FOLDER)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes).startswith(schema)


def test_personal_data_digest(spark):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    some = 0
    for r in QUERIES["op10_pii"](spark, FOLDER).collect():
        base = personal.seeds(docs[r.doc_id])
        listed = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
        some += len(base)
    assert some


def run_stages(spark, docs, folder):
    """(name, input, output) of each stage, each written and read again."""
    from tablemill.session import staged

    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, folder))
        yield name, docs, out
        docs = out


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_every_stage_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = {name: (given, out) for name, given, out in run_stages(spark, docs, FOLDER)}
    assert list(stages) == ["toxicity", "simhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    assert all(out.columns == columns for name, (_, out) in stages.items() if name != "best_fit_packing")

    given, out = stages["toxicity"]
    judged = {r.doc_id for r in toxicity.toxicity(given, labels).collect() if not r.predicted}
    assert set(by_id(out)) == judged and out.count() == len(judged) < given.count()

    given, out = stages["simhash_near_dedup"]
    rows = [(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()]
    assert set(by_id(out)) == {c for _, _, c in plain_near_duplicates(rows)} and out.count() < given.count()

    given, out = stages["pii"]
    before, after = by_id(given), by_id(out)
    assert set(before) == set(after)
    for i, [r] in after.items():
        assert not personal.seeds(r.text) and r.n_chars == len(r.text)
        assert personal.seeds(before[i][0].text) or r.text == before[i][0].text

    given, out = stages["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mix(given).collect()}
    assert {i: sum(len(words(r.text)) for r in rows) for i, rows in by_id(out).items()} == {i: n for i, n in taken.items() if n}

    given, out = stages["best_fit_packing"]
    kept = [len(words(r.text)) for r in given.collect()]
    packed = out.collect()
    check_layout(packed, (512, 1024, 2048, 4096), kept)
    assert sum(len(words(r.text)) for r in packed) == sum(kept)


def test_run_gives_the_last_stage(spark):
    want = [out for *_, out in run_stages(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)][-1]
    got = corpus_pipeline.run(spark, FOLDER)
    key = lambda r: (r.doc_id, r.piece, r.n_words, r.text)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_stages_survive_awkward_rows(spark):
    docs = clashing(documents(spark))
    for _, given, out in run_stages(spark, docs, FOLDER):
        assert out.count() > 0
    for _, given, out in run_stages(spark, documents(spark, []), FOLDER):
        assert out.count() == 0


