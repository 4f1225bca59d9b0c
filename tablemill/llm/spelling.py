"""Grouping of spelling variants: words one edit apart, by asymmetric q-chunks.

Of two words one edit apart the longer one (of equals either) contributes two disjoint chunks,
its halves; the other contributes its positional grams of the same length. One edit leaves one
half whole, and moves it by no more than the difference of the lengths. So a chunk meets a gram
only if text, half and length of the longer word agree and their places differ by that shift, 0
or 1; other grams could join nothing and are not written. What meets is verified by its edit
distance.

A chunk that many words share, such as a common stem, is not paired up. Two words that share it
differ by one code point in the other half, so there each word gives one key for every deleted
place: words with one key are one edit apart, and a key has no more words than there are letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablemill.llm.common import release, staged

#: What a word is made of, and the letters whose case is folded.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words that share a chunk are paired directly up to this many.
PAIRED = 64


def runs(text: str | Column) -> Column:
    """The maximal runs of letters of a text, A to Z in lower case."""
    text = F.col(f"`{text}`") if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))


def without(word: str | Column, at: Column) -> Column:
    """``word`` without the code point at ``at``, counted from 0."""
    word = F.col(word) if isinstance(word, str) else word
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of so many code points and occurrences; NULL is no word."""
    long = words.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """(key, chunk, length, half, word, n): two rows with ``chunk`` per word, and its grams.

    ``length`` is that of the word whose chunk a gram could be, its own or one more.
    """
    size = F.length("word")
    # (is a chunk, length of the longer word, which half)
    forms = [(True, size, 0), (True, size, 1), (False, size, 0), (False, size, 1), (False, size + 1, 0), (False, size + 1, 1)]

    def part(chunk: bool, length: Column, half: int) -> Column:
        middle = F.floor(length / 2).cast("int")
        # The second half of the longer word starts here in this one, moved by the difference.
        start, many = (F.lit(0), middle) if half == 0 else (middle + size - length, length - middle)
        text = F.substring("word", start + 1, many)
        key = F.xxhash64(length, F.lit(half), text)
        return F.struct(key.alias("key"), F.lit(chunk).alias("chunk"), length.alias("length"), F.lit(half).alias("half"))

    parts = F.explode(F.array(*[part(*f) for f in forms])).alias("part")
    return vocabulary.select("word", "n", parts).select("part.*", "word", "n")


def _sides(chunks: DataFrame, grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        chunks.select("key", F.col("word").alias("a"), F.col("n").alias("a_n")),
        grams.select("key", F.col("word").alias("b"), F.col("n").alias("b_n")),
    )


def _by_deletion(crowded: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs that share a crowded chunk and agree but for one place."""
    middle = F.floor(F.col("length") / 2).cast("int")
    first = F.when(F.col("half") == 0, middle).otherwise(F.lit(0))
    last = F.when(F.col("half") == 0, F.col("length")).otherwise(middle) - 1
    place = F.explode(F.sequence(first, last)).alias("place")
    # Equal words come by several keys; the place keeps replacements at different places apart.
    cut = crowded.where(F.length("word") == F.col("length")).select("key", "chunk", "length", "word", "n", place)
    rest = F.xxhash64("key", without("word", F.col("place")))
    cut = cut.select("chunk", "word", "n", "place", rest.alias("rest"))
    shorter = crowded.where(F.length("word") < F.col("length"))
    shorter = shorter.select("word", "n", F.xxhash64("key", "word").alias("rest"))
    # Chunk rows and gram rows of a word's own length are the same words, so one side serves both.
    cut = cut.where("chunk")
    a = cut.select(F.xxhash64("rest", "place").alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = a.select("key", F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    replaced = a.join(b, "key").where("a < b")
    one = cut.select(F.col("rest").alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    two = shorter.select(F.col("rest").alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    return replaced.unionByName(one.join(two, "key")).drop("key")


def near_pairs(vocabulary: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, a_n, b, b_n), once for each two words of ``vocabulary`` (word, n) exactly one edit apart.

    An edit inserts, deletes or replaces one code point. ``word`` is unique and not NULL.
    """
    keyed = _keyed(vocabulary)
    # Words of the chunk side are on the gram side too, so the grams of a key bound both.
    crowds = keyed.where("NOT chunk").groupBy("key").agg(F.count(F.lit(1)).alias("many"))
    keyed = staged(keyed.join(crowds, "key", "left"), "spelling-keys")
    few, crowded = F.coalesce("many", F.lit(0)) <= paired, F.col("many") > paired
    a, b = _sides(keyed.where("chunk").where(few), keyed.where("NOT chunk").where(few))
    # Of equally long words each is on both sides; one order is enough.
    met = a.join(b, "key").where((F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))).drop("key")
    found = met.unionByName(_by_deletion(keyed.where(crowded)))
    return found.where(F.levenshtein("a", "b", 1) == 1).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that the forms of (word, form) lead to.

    A form has ``RATIO`` times the occurrences of its word, so there are no circles and chains
    are short; each round doubles the steps taken.
    """
    at = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(further, "root", "left")
        moved = staged(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, paired: int = PAIRED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``words`` (word), one row per occurrence.

    Words of fewer code points or occurrences take no part, nor do NULLs. ``form`` is the near
    word of most occurrences, the first in code-point order among equals, if it has ``ratio``
    times those of the word; else NULL. ``root`` follows forms to the last, and is the word itself
    where it has none. No words give an empty table.
    """
    vocabulary = staged(counted(words, least_length, least_count), "spelling-words")
    release(words.sparkSession)
    pairs = staged(near_pairs(vocabulary, paired), "spelling-pairs")
    other = pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("turned"), F.col("b").alias("near"))).alias("best")
    near = pairs.unionByName(other).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    near = vocabulary.join(near, "word", "left")
    enough = -F.col("best.turned") >= ratio * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.turned")).alias("form_n"),
    )
    near = staged(near, "spelling-forms")
    roots = _roots(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text_col: str = "text", **bounds: int) -> DataFrame:
    """``variants`` of the words of all texts; NULL and empty texts have none. Extra columns are ignored."""
    return variants(docs.select(F.explode(runs(text_col)).alias("word")), **bounds)


__all__ = ["counted", "near_pairs", "runs", "spelling_variants", "variants", "without"]
