"""Personal data by bootstrapped contextual extraction.

Four kinds are found by their form: e-mail addresses, IP addresses, payment cards and phone
numbers. These seeds induce lexical patterns, the words around them. Patterns and the
identifier-like strings they surround form a graph. In rounds, until one finds nothing new, Spark scores it: a pattern
by the share of its strings that are known to be of a kind, a string by the patterns around
it. Strings that patterns of high confidence surround in most of their places count as known
in the next round, and in the end every place where such a string stands is added to the
seeds. Of strings that stand mostly elsewhere, or are too short to be one thing everywhere, as
years are, only the places in patterns of high confidence are added.

The texts are read once; the graph is frames throughout, pre-aggregated before each join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablemill.llm.common import free, release, small_batches, staged, text_bytes

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs so many distinct known strings of a kind, and such a share of all its strings.
SUPPORT, CONFIDENCE = 5.0, 0.8
#: A string needs such a score: one minus the product of its patterns' doubts.
ACCEPT = 0.9
#: It is meant wherever it stands if patterns of high confidence surround such a share of its
#: places, and it has so many digits, or an @.
SHARE, TELLING_DIGITS = 0.5, 7
#: Unseen identifiers have so many digits, or an @; those of several groups no more than a card.
LEAST_DIGITS, MOST_DIGITS = 4, 19
#: Characters before and after a string in which its neighbouring words are looked for.
CONTEXT = 80

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match can start inside a run of digits whose start gives none, so runs are taken whole.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Digit groups as seeds join them; the whole is one string.
_GROUPS = re.compile(r"(?<![0-9])[+(]?[0-9]++(?:(?:\x20?[()]\x20?|\)[.-]|\x20-\x20|[\x20.-])[0-9]++)++")
_HINT = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_SPACE = frozenset("\t\n\x0b\x0c\r ")
_EDGES = ".,;:!?\"'()[]{}<>#*$%&=|_"
_DIGITS = re.compile(r"[0-9]")
_DIGIT_RUNS = re.compile(r"[0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the expression finds them from left to right, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strings of known form, by start and kind; kinds count from 0."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _around(text: str, start: int, end: int) -> list[str]:
    """The two patterns of a place: two words to the left; one to the left and one to the right."""
    left = _DIGITS.sub("0", text[max(0, start - CONTEXT) : start].lower()).split()[-2:]
    right = _DIGITS.sub("0", text[end : end + CONTEXT].lower()).split()[:1]
    left = ["^"] * (2 - len(left)) + left
    return [f"{left[0]} {left[1]} _", f"{left[1]} _ {right[0] if right else '$'}"]


def _grouped(text: str, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Digit groups with blanks or brackets between them, as of national phones and of cards.

    They stand in ``text[first:last]``. A last group of one digit, or groups of mostly one, are
    no identifier; nor is a part of a word.
    """
    for m in _GROUPS.finditer(text, first, last):
        start, end = m.span()
        if m[0][0] == "(" and ")" not in m[0]:
            start += 1
        groups = _DIGIT_RUNS.findall(m[0])
        digits = sum(map(len, groups))
        if not LEAST_DIGITS <= digits <= MOST_DIGITS or len(groups[-1]) < 2 or digits < 2 * len(groups) - 1:
            continue
        if not any(c in " ()" for c in m[0][1:]):
            continue
        # Edges may enclose the whole, as long as white space or the text's end is behind them.
        before, after = start, end
        while before and text[before - 1] in _EDGES:
            before -= 1
        while after < len(text) and text[after] in _EDGES:
            after += 1
        if (not before or text[before - 1] in _SPACE) and (after == len(text) or text[after] in _SPACE):
            yield start, end


def _candidates(text: str, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like words, and digit groups as one, that no seed overlaps."""
    merged: list[list[int]] = []
    for s, _, e in known:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    # Between seeds, as what failed to be one may hold an identifier beside a seed.
    ends = [0, *(x for span in merged for x in span), len(text)]
    grouped = [[s, e] for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b for s, e in _grouped(text, a, b)]
    yield from ((s, e) for s, e in grouped)
    # Neither lists' spans overlap, so the words are those outside both.
    merged = sorted(merged + grouped)
    at = 0
    for m in _HINT.finditer(text):
        start, end = m.span()
        while start and text[start - 1] not in _SPACE:
            start -= 1
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        while at < len(merged) and merged[at][1] <= start:
            at += 1
        if start >= end or (at < len(merged) and merged[at][0] < end):
            continue
        word = text[start:end]
        if len(_DIGITS.findall(word)) >= LEAST_DIGITS or ("@" in word and word.strip("@") == word):
            yield start, end


_SPAN = "struct<start:int,kind:int,end:int>"
_PLACE = "struct<start:int,end:int,kind:int,value:string,patterns:array<string>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
    for batch in batches:
        bases, places = [], []
        for t in batch.column(2):
            text = (t.as_py() or b"").decode("utf-8", "replace")
            known = seeds(text)
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in known])
            spots = [(s, e, k) for s, k, e in known] + [(s, e, None) for s, e in _candidates(text, known)]
            places.append([{"start": s, "end": e, "kind": k, "value": text[s:e], "patterns": _around(text, s, e)} for s, e, k in spots])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bases, span), pa.array(places, place)], ["row", "id", "base", "places"])


def scored(edges: DataFrame, rounds: int | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """(value, kind, score, whole) of the strings found by patterns alone.

    ``edges`` has (pattern, value, kind): once for each pattern and string that stand together,
    with the kind a seed has, else NULL; and n, in how many places they do (1 if there is no such
    column). A pattern stands for at most one kind, that with the most support. ``whole`` says
    that the string is meant in all its places, not only in those of trusted patterns. With a
    round's new whole strings known, further patterns may qualify; what is known stays known, and
    by default the rounds go on until one finds nothing new.
    """
    return _scored(edges, rounds, support, confidence, accept)[0]


def _scored(edges: DataFrame, rounds: int | None, support: float = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """What ``scored`` gives, and the trusted (pattern, kind, support, trust)."""
    spark = edges.sparkSession
    edges = edges if "n" in edges.columns else edges.withColumn("n", F.lit(1))
    known = edges.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    known = sure = staged(known, "pii-known")
    open_edges = edges.where("kind IS NULL").groupBy("pattern", "value").agg(F.sum("n").alias("n"))
    open_edges = staged(open_edges, "pii-open")
    # A place has two patterns, one of them with both words to the left.
    places = staged(open_edges.groupBy("value").agg((F.sum("n") / 2).alias("places")), "pii-places")
    every = staged(edges.select("pattern", "value").distinct(), "pii-edges")
    left = F.col("pattern").endswith(" _")
    telling = F.col("value").contains("@") | (F.length(F.regexp_replace("value", "[^0-9]", "")) >= TELLING_DIGITS)
    whole = new = spark.createDataFrame([], "value string, kind int, score double, whole boolean")
    trusted = spark.createDataFrame([], "pattern string, kind int, support double, trust double")
    for k in count():
        if k == rounds:
            break
        joined = every.join(known, "value", "left")
        sums = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"k{k}") for k in range(len(KINDS))]
        per = joined.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *sums)
        best = F.greatest(*[F.struct(F.col(f"k{k}").alias("sum"), F.lit(k).alias("kind")) for k in range(len(KINDS))])
        # One string more than seen, of no kind, keeps the confidence below 1.
        per = per.select("pattern", best["kind"].alias("kind"), best["sum"].alias("support"), (best["sum"] / (F.col("n") + 1)).alias("trust"))
        trusted = staged(per.where((F.col("support") >= support) & (F.col("trust") >= confidence)), "pii-patterns")
        doubt = F.sum(F.log1p(-F.col("trust")))
        inside = F.greatest(*[F.sum(F.when(x, F.col("n")).otherwise(0)) for x in (left, ~left)])
        found = open_edges.join(trusted, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"), inside.alias("inside"))
        pick = F.max(F.struct("score", (-F.col("kind")).alias("turned"), "inside")).alias("pick")
        found = found.groupBy("value").agg(pick).select("value", (-F.col("pick.turned")).alias("kind"), "pick.score", "pick.inside")
        found = found.where(F.col("score") >= accept).join(known.select("value"), "value", "left_anti").join(places, "value")
        meant = telling & (F.col("inside") >= SHARE * F.col("places"))
        new = staged(found.select("value", "kind", "score", meant.alias("whole")), "pii-new")
        if new.where("whole").isEmpty():
            break
        whole = staged(whole.unionByName(new.where("whole")), "pii-whole")
        known = sure.unionByName(whole.drop("whole"))
    return whole.unionByName(new.where("NOT whole")), trusted


def _found(docs: DataFrame, id_col: str, text_col: str, rounds: int | None) -> DataFrame:
    """(row, id, base, more): spans of known form, and those the patterns add."""
    id_, t = F.col(f"`{id_col}`").cast("long"), text_bytes(text_col)
    rows = docs.select(F.xxhash64(id_, t).alias("row"), id_.alias("id"), t.alias("t"))
    small_batches(docs.sparkSession)
    scanned = staged(rows.mapInArrow(_scanned, f"row long, id long, base array<{_SPAN}>, places array<{_PLACE}>"), "pii-scanned")
    places = scanned.select("row", "id", F.explode("places").alias("p")).select("row", "id", "p.*")
    edges = places.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value")
    edges = edges.agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    strings, trusted = _scored(staged(edges, "pii-graph"), rounds)
    spots = places.where("kind IS NULL").select("row", "id", "start", "end", "value", "patterns")
    hits = spots.join(strings, "value")
    inside = hits.where("NOT whole").withColumn("pattern", F.explode("patterns")).join(trusted.select("pattern", "kind"), ["pattern", "kind"])
    spans = [x.select("row", "id", F.struct("start", "kind", "end").alias("span")) for x in (hits.where("whole"), inside)]
    # Equal rows give equal places, so each place counts once.
    more = spans[0].unionByName(spans[1]).groupBy("row", "id").agg(F.collect_set("span").alias("more"))
    more = staged(more.select("row", F.col("id").alias("of"), "more"), "pii-more")
    release(docs.sparkSession)
    same = (F.col("row") == F.col("of_row")) & F.col("id").eqNullSafe(F.col("of"))
    joined = scanned.select("row", "id", "base").join(more.withColumnRenamed("row", "of_row"), same, "left")
    return joined.select("row", "id", "base", F.coalesce("more", F.array().cast(f"array<{_SPAN}>")).alias("more"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs``.

    ``base`` holds (start, kind, end) of the strings of known form, ``spans`` those and the ones
    that patterns add; both by start, then kind (0 email, 1 ip, 2 card, 3 phone). Offsets count
    code points, the end is exclusive. NULL counts as an empty text; both have no spans. Equal
    rows get equal spans. A NULL id is kept. An empty table gives an empty one. Extra columns
    are ignored.
    """
    found = _found(docs, id_col, text_col, rounds)
    spans = F.array_sort(F.array_union("base", "more"))
    return found.select(F.col("id").alias("doc_id"), "base", spans.alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets, as ``[EMAIL]``.

    Of spans that overlap, the first names the kind and all are replaced together. Texts without
    spans, NULL among them, stay as they are; so do all other columns.
    """
    names = docs.columns
    id_, t = F.col(f"`{id_col}`").cast("long"), text_bytes(text_col)
    row, spans, of_row, of_id = (free(names, x) for x in ("__row", "__spans", "__of_row", "__of_id"))
    found = _found(docs, id_col, text_col, rounds).where(F.size("more") > 0)
    # Strings of known form are found again where the text is; only what patterns add is joined.
    found = found.select(F.col("row").alias(of_row), F.col("id").alias(of_id), F.col("more").alias(spans))
    # Equal rows of one id have equal spans; one of them is enough.
    found = staged(found.dropDuplicates([of_row, of_id]), "pii-spans")
    same = (F.col(row) == F.col(of_row)) & id_.eqNullSafe(F.col(of_id))
    joined = docs.withColumn(row, F.xxhash64(id_, t)).join(found, same, "left")
    text = F.arrow_udf(_cut, "string")(t, F.col(spans))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names])


def _without(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with names for its spans (start, kind, end), which come in order."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _cut(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for column, added in texts:
        out = []
        for t, more in zip(column, added, strict=True):
            raw = t.as_py()
            if raw is not None:
                text = raw.decode("utf-8", "replace")
                extra = {(x["start"], x["kind"], x["end"]) for x in more.as_py() or ()}
                spans = sorted(extra.union(seeds(text)))
                raw = _without(text, spans).encode() if spans else raw
            out.append(raw)
        yield pa.array(out, pa.binary()).cast(pa.string())


__all__ = ["KINDS", "personal_data", "redacted", "scored", "seeds"]
