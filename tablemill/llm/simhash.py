"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

The binary Golay code of 23 bits covers every word: each lies within 3 bits of exactly one
of its 4096 codewords. Two words at 2 bits or fewer have a word between them, 1 bit or fewer
from both, so the codewords of their 1-bit surroundings meet: 6 indices for most words, 1 for
the rest. A 64-bit fingerprint is cut into three segments. Two bits in error leave at least
one segment without any (pigeonhole), so a key is one segment as it is, together with an
index of the segment after it: 16 keys or so per fingerprint, each of 33 bits or more.

Fingerprints that share a key are joined and their bits compared. A key that very many
fingerprints share is not paired up: each of its fingerprints takes the 65 keys "itself and
each single bit turned". Two of them share one if and only if they differ in 2 bits or
fewer, at most 65 share any, and all those are linked to the least. That is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablemill.llm.common import free, release, small_batches, text_bytes
from tablemill.llm.components import components
from tablemill.session import work_path

SEED = 42
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, generates the Golay code
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, width)
#: Fingerprints that share a key are compared pairwise up to this many, beyond it by single-bit keys.
PAIRED = 64


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if set in more than half of the shingles' hashes."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(s, SEED) for s in shingles])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per document; ``fp`` is the fingerprint as a signed 64-bit number.

    ASCII capitals count as small letters; words are runs of anything but ASCII white space.
    Fewer words than a shingle make one shingle, no word (or NULL) gives 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of each 12-bit head, error pattern of each remainder) of the Golay code."""

    def remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
        return words

    heads = remainder(np.arange(4096, dtype=np.int64) << 11)
    one = 1 << np.arange(23, dtype=np.int64)
    two = (one[:, None] | one)[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] | one).ravel())
    three = three[np.bitwise_count(three) == 3]
    errors = np.zeros(2048, np.int64)
    for patterns in (one, two, three):
        errors[remainder(patterns)] = patterns
    return heads, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word."""
    heads, errors = _golay()
    words = words.astype(np.int64)
    return (words ^ errors[heads[words >> 11] ^ (words & 2047)]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all keys of the fingerprints."""
    fps = fps.astype(np.uint64)
    parts = [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    at, keys = [], []
    for k, exact in enumerate(parts):
        after = (k + 1) % len(parts)
        turns = np.concatenate([[0], 1 << np.arange(SEGMENTS[after][1], dtype=np.int64)])
        index = np.sort(golay_index(parts[after][:, None] ^ turns), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(new)
        at.append(row)
        keys.append((np.int64(k) << 40) | exact[row] << 12 | index[row, col])
    return np.concatenate(at), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(start, 4096).to_numpy(zero_copy_only=False)
                at, keys = fuzzy_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], ["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def linked_fingerprints(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` at 2 bits or fewer.

    Not every pair comes out: within a key that more than ``paired`` fingerprints share, those
    around one word are linked to the least of them. The components are those of all pairs.
    """
    spark = fps.sparkSession
    path = work_path(spark, "golay-keys")
    _keyed(fps.select("fp").distinct()).write.parquet(path)
    keyed = spark.read.schema("key long, fp long").parquet(path)
    # Members come together per key up to the bound only; larger keys keep their count.
    sizes_path = work_path(spark, "golay-sizes")
    keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").write.parquet(sizes_path)
    sizes = spark.read.schema("key long, n long").parquet(sizes_path)
    small_path = work_path(spark, "golay-small")
    keyed.join(sizes.where(F.col("n") <= paired).select("key"), "key").write.parquet(small_path)
    small = spark.read.schema("key long, fp long").parquet(small_path)
    left = small.select("key", F.col("fp").alias("a"))
    right = small.select(F.col("key").alias("same"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = left.join(right, (F.col("key") == F.col("same")) & (F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = keyed.join(sizes.where(F.col("n") > paired).select("key"), "key", "left_semi").select("fp").distinct()
    turned = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = crowded.select("fp", F.explode(F.concat(F.array("fp"), turned)).alias("word"))
    near_path = work_path(spark, "golay-around")
    around.groupBy("word").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").write.parquet(near_path)
    least = spark.read.schema("word long, least long, n long").parquet(near_path)
    stars = around.join(least.select("word", "least"), "word").where("fp != least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest id reachable
    over links of 2 differing bits or fewer, itself included. Texts without words (NULL, empty)
    have fingerprint 0 and are linked like any other. Rows of one id each get a row. Rows whose
    id is NULL have NULL as id; they link others, and get NULL only if their whole component has
    no id. An empty table gives an empty one. Extra columns are ignored.
    """
    spark = docs.sparkSession
    path = work_path(spark, "fingerprints")
    fingerprints(docs, id_col, text_col).write.parquet(path)
    rows = spark.read.schema("id long, fp long").parquet(path)
    # One row per distinct fingerprint; copies are counted out before the shuffle.
    firsts_path = work_path(spark, "fingerprint-firsts")
    rows.groupBy("fp").agg(F.min("id").alias("first")).write.parquet(firsts_path)
    firsts = spark.read.schema("fp long, first long").parquet(firsts_path)
    found = components(linked_fingerprints(firsts, paired))
    found_path = work_path(spark, "fingerprint-components")
    joined = firsts.join(found.withColumnRenamed("vertex", "fp"), "fp", "left")
    joined.select("fp", "first", F.coalesce("component", "fp").alias("component")).write.parquet(found_path)
    release(spark)
    groups = spark.read.schema("fp long, first long, component long").parquet(found_path)
    least_path = work_path(spark, "component-firsts")
    groups.groupBy("component").agg(F.min("first").alias("component_id")).write.parquet(least_path)
    least = spark.read.schema("component long, component_id long").parquet(least_path)
    by_fp_path = work_path(spark, "component-ids")
    groups.join(least, "component").select("fp", "component_id").write.parquet(by_fp_path)
    by_fp = spark.read.schema("fp long, component_id long").parquet(by_fp_path)
    out = rows.join(by_fp, "fp")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Of rows that share that id one stays, that with the least hash over all columns. A row
    whose id is NULL can't be named by a component and stays as it is.
    """
    spark = docs.sparkSession
    names = docs.columns
    first, rank = free(names, "__first"), free(names, "__rank")
    path = work_path(spark, "component-heads")
    found = near_duplicates(docs, id_col, text_col)
    found.where("component_id IS NOT NULL").select("component_id").distinct().write.parquet(path)
    heads = spark.read.schema("component_id long").parquet(path).withColumnRenamed("component_id", first)
    every = [F.col(f"`{c}`") for c in names]
    id_ = F.col(f"`{id_col}`")
    left = docs.join(heads, id_.cast("long") == F.col(first), "left_semi")
    one = Window.partitionBy(id_).orderBy(F.xxhash64(*every))
    left = left.withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).select(*every)
    return left.unionAll(docs.where(id_.isNull()))


__all__ = ["fingerprint", "fingerprints", "fuzzy_keys", "golay_index", "keep_one", "linked_fingerprints", "near_duplicates"]
