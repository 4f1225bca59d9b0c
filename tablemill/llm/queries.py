"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablemill.llm import archives, balltree, kmeanstree, licences, mixing, packing, periods, personal, repeats, simhash, spelling
from tablemill.llm import tokenplanes, toxicity
from tablemill.llm.common import WORD
from tablemill.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query()
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


OP4_SQL = r"""
WITH docs AS (
    SELECT doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), per AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), flows AS (
    SELECT source, source_size, 2 * source_size AS most,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
    FROM per
), filled AS (
    SELECT *,
           coalesce(sum(most) OVER before, 0)::BIGINT AS before_most,
           coalesce(sum(weight) OVER before, 0)::BIGINT AS before_weight,
           most::DOUBLE / weight::DOUBLE AS full_at
    FROM flows
    WINDOW before AS (
        ORDER BY most::DOUBLE / weight::DOUBLE, coalesce('=' || source, '')
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sums AS (
    SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE AS budget, sum(weight)::DOUBLE AS parts FROM flows
), levels AS (
    SELECT f.*, (budget - before_most::DOUBLE) / (parts - before_weight::DOUBLE) AS reach, budget
    FROM filled f, sums
), top AS (
    SELECT max(reach) AS reached FROM levels WHERE full_at >= reach
), goals AS (
    SELECT source, source_size, budget,
           least(most::DOUBLE, coalesce(weight::DOUBLE * reached, most::DOUBLE)) AS target
    FROM levels, top
), laps AS (
    SELECT d.doc_id, d.size, g.source, g.source_size, g.target, g.budget, lap,
           md5('mix:' || lap::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, '')) AS draw
    FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source,
         (VALUES (1), (2)) AS l(lap)
    WHERE lap = 1 OR (lap - 1) * g.source_size < g.target
), served AS (
    SELECT *, sum(size) OVER (
        PARTITION BY source ORDER BY lap, draw, size, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / nullif(target, 0) AS finish
    FROM laps
), line AS (
    SELECT *, sum(size) OVER (
        ORDER BY finish NULLS LAST, draw, size, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
    FROM served
)
SELECT doc_id, max(size) AS size, max(source_size) AS source_size, max(target) AS target,
       (max(size) * sum(CASE WHEN total <= budget AND finish IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM line
GROUP BY doc_id
"""


@query(OP4_SQL)
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document a mix of 150 % of all words takes."""
    return mixing.mix(table(spark, folder, "documents"))


@query()
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page through ARC archives, their conversion to WARC, and back."""
    return archives.archived(table(spark, folder, "pages"))


@query()
def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without passages of 50 words that an earlier document holds."""
    found = repeats.without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def _listed(spans: str) -> Column:
    kind = F.array(*[F.lit(k) for k in personal.KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(one, ",")


@query()
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document; the counts are of the strings of known form."""
    found = personal.personal_data(table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in range(len(personal.KINDS))]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{name}") for n, name in zip(counts, personal.KINDS, strict=True)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


@query()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


OP1_SQL = """
WITH ints AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM ints q JOIN ints c ON q.vec_id % 20 = 0 AND q.n <> c.n AND len(q.v) = len(c.v)
), ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query(OP1_SQL)
def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector."""
    return balltree.top_k(table(spark, folder, "embeddings"))


@query()
def op6_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found of every twentieth vector."""
    return kmeanstree.neighbours(table(spark, folder, "embeddings"))


@query(licences.oracle_sql())
def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    """The licence every document is, if any, and the notices it holds."""
    return licences.licences(table(spark, folder, "documents"))


@query()
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Where every piece of every document stands in the packed sequences."""
    return packing.packing(table(spark, folder, "documents"))


@query()
def op11_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token ids, written as files of planes and read back."""
    import public_tokenizers

    return tokenplanes.encoded(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _with_slips(docs: DataFrame) -> DataFrame:
    """The words of all documents, some of them, by their checksum, without one code point."""
    word_runs = docs.select("doc_id", F.explode(spelling.runs("text")).alias("run"))
    # Shorter ones are no words, whole or not.
    word_runs = word_runs.where(F.length("run") >= spelling.LEAST_LENGTH)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    slip = spelling.without("run", (h % F.length("run")).cast("int"))
    return word_runs.select(F.when(h % 199 == 0, slip).otherwise(F.col("run")).alias("word"))


@query()
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """The more frequent spelling, if any, of every word of the documents."""
    return spelling.variants(_with_slips(table(spark, folder, "documents")))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them, by the checksum of the id, periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    docs = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, found).alias("words"))
    n = F.size("words").cast("long")
    docs = docs.select("*", F.when(n > 0, F.expr("(h div 10) % size(words)")).alias("a"), n.alias("n"))
    p = F.expr("1 + (n - a) div (3 + (h div 10) % 8)")
    docs = docs.select("*", p.cast("int").alias("p"))
    part = F.slice("words", F.col("a").cast("int") + 1, F.col("p"))
    tail = F.flatten(F.array_repeat(part, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), F.lit(1), F.col("n").cast("int"))
    text = F.when(F.col("p").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


@query()
def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of every document, the longest for its period, and what is left without repeats."""
    found = periods.runs_and_rest(_with_planted_runs(table(spark, folder, "documents")))

    def better(best: Column, run: Column) -> Column:
        # Runs come by start and period, so the first of equals stays.
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)

    best = F.when(F.size("runs") > 0, F.reduce("runs", F.get("runs", F.lit(0)), better))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    found = found.select("*", best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
