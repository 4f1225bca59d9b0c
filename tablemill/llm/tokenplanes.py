"""Token ids in binary files: blocks of ids transposed into planes, compressed one by one.

A file holds documents one after the other, cut into blocks of a fixed number of ids without
regard to where documents end. A block is transposed into byte planes (all low bytes, then all
second bytes, ...) or bit planes, no more of them than its largest id needs, and each plane is
compressed with zstandard. Behind the blocks an index names the place, ids and plane sizes of
every block and the id, place and length of every document, so that any stretch of ids is read
from the blocks that hold it.

    magic | kind, ids a block, slice, number | planes ... | index | index size, its CRC-32, magic

Numbers are little-endian. ``slice`` and ``number`` order the files. A file is one row on its way to
the file system, so its size is bounded when it is written: it ends with the document that
fills it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablemill.llm.common import staged, text_bytes
from tablemill.session import work_path

MAGIC = b"TMPLANE1"
_HEAD = struct.Struct("<8sB3xIII")
_TAIL = struct.Struct("<QI8s")
_SIZES = struct.Struct("<QQ")
PLANES = ("byte", "bit")
#: Ids of a block, and ids after which a file ends with its document.
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 22
LEVEL = 3
_BLOCK = np.dtype([("at", "<u8"), ("ids", "<u4"), ("planes", "<u4")])
_DOCUMENT = np.dtype([("known", "u1"), ("id", "<i8"), ("start", "<u8"), ("ids", "<u8")])


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first, up to the highest one in use."""
    bits = int(ids.max(initial=0)).bit_length()
    if kind == "byte":
        table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [table[:, p].tobytes() for p in range((bits + 7) // 8)]
    return [np.packbits((ids >> p & 1).astype(np.uint8), bitorder="little").tobytes() for p in range(bits)]


def ids_of(planes: Sequence[bytes], n: int, kind: str) -> np.ndarray:
    """The ``n`` ids of a block from its planes."""
    if kind == "byte":
        table = np.zeros((n, 4), np.uint8)
        for p, plane in enumerate(planes):
            table[:, p] = np.frombuffer(plane, np.uint8)
        return table.reshape(-1).view("<u4")
    ids = np.zeros(n, np.uint32)
    for p, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(p)
    return ids


class Writer:
    """One file, filled document by document."""

    def __init__(self, slice_: int, number: int, kind: str, block_ids: int, level: int):
        self.kind, self.block_bytes = kind, 4 * block_ids
        self.pack = zstandard.ZstdCompressor(level=level)
        self.parts = [_HEAD.pack(MAGIC, PLANES.index(kind), block_ids, slice_, number)]
        self.at, self.rest, self.ids = _HEAD.size, bytearray(), 0
        self.blocks, self.sizes, self.documents = [], [], []

    def add(self, id_: int | None, ids: bytes) -> None:
        """``ids`` are unsigned 32-bit numbers, little-endian."""
        self.documents.append((id_ is not None, id_ or 0, self.ids, len(ids) // 4))
        self.ids += len(ids) // 4
        self.rest += ids
        while len(self.rest) >= self.block_bytes:
            self._block(self.block_bytes)

    def _block(self, size: int) -> None:
        ids = np.frombuffer(bytes(self.rest[:size]), "<u4")
        del self.rest[:size]
        packed = [self.pack.compress(p) for p in planes_of(ids, self.kind)]
        self.blocks.append((self.at, len(ids), len(packed)))
        self.sizes += map(len, packed)
        self.parts += packed
        self.at += sum(map(len, packed))

    def whole(self) -> bytes:
        if self.rest:
            self._block(len(self.rest))
        index = _SIZES.pack(len(self.blocks), len(self.documents)) + np.array(self.blocks, _BLOCK).tobytes()
        index += np.array(self.sizes, "<u4").tobytes() + np.array(self.documents, _DOCUMENT).tobytes()
        index = self.pack.compress(index)
        return b"".join([*self.parts, index, _TAIL.pack(len(index), zlib.crc32(index), MAGIC)])


class Reader:
    """A file's documents, and any stretch of its ids."""

    def __init__(self, content: bytes):
        self.content = content
        magic, kind, self.block_ids, self.slice, self.number = _HEAD.unpack_from(content)
        size, check, end = _TAIL.unpack_from(content, len(content) - _TAIL.size)
        index = content[len(content) - _TAIL.size - size : len(content) - _TAIL.size]
        if magic != MAGIC or end != MAGIC or zlib.crc32(index) != check:
            raise ValueError("not a whole file of token ids")
        self.kind, self.unpack = PLANES[kind], zstandard.ZstdDecompressor()
        index = self.unpack.decompress(index)
        blocks, documents = _SIZES.unpack_from(index)
        self.blocks = np.frombuffer(index, _BLOCK, blocks, _SIZES.size)
        at = _SIZES.size + self.blocks.nbytes
        self.sizes = np.frombuffer(index, "<u4", int(self.blocks["planes"].sum()), at)
        self.documents = np.frombuffer(index, _DOCUMENT, documents, at + self.sizes.nbytes)
        self.first_plane = np.cumsum(np.append(0, self.blocks["planes"]))

    def block(self, k: int) -> np.ndarray:
        at, n, _ = self.blocks[k].tolist()
        planes = []
        for size in self.sizes[self.first_plane[k] : self.first_plane[k + 1]].tolist():
            planes.append(self.unpack.decompress(self.content[at : at + size]))
            at += size
        return ids_of(planes, n, self.kind)

    def stretch(self, start: int, n: int) -> Iterator[np.ndarray]:
        """``n`` ids from ``start`` on, block by block; only blocks that hold some are unpacked."""
        while n > 0:
            k, skip = divmod(start, self.block_ids)
            ids = self._held(k)[skip : skip + n]
            yield ids
            start, n = start + len(ids), n - len(ids)

    def _held(self, k: int) -> np.ndarray:
        # Documents are read in order, so the block at hand is mostly the one before.
        if getattr(self, "held", (None,))[0] != k:
            self.held = (k, self.block(k))
        return self.held[1]


#: A space between two characters that aren't white space begins a piece of its own for every
#: byte-level tokenizer that keeps a space with the word behind it.
_PIECE = re.compile(r"(?<=\S) (?=\S)")
#: Where a text has none of these, spaces and line feeds stand alone between other characters.
_ODD = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x80)) if c.isspace() and c not in " \n"))
_ODD_WIDE = (*_ODD, *(c for c in map(chr, range(0x80, 0x3001)) if c.isspace()))
#: Pieces whose ids a worker remembers, some 200 bytes each.
REMEMBERED = 1_000_000


def _odd(text: str) -> bool:
    return any(map(text.__contains__, _ODD if text.isascii() else _ODD_WIDE))


def _pieces(texts: Sequence[str], odd: bool) -> pa.ListArray:
    """Each text in pieces that can be encoded one by one; all but its first lack the space before them.

    A piece that begins with a line feed has no space before it.
    """
    if odd:
        return pa.array([_PIECE.split(t) for t in texts], pa.list_(pa.string()))
    return pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")


class Encoder:
    """Ids of whole texts, by the ``tokenizers`` library, as little-endian 32-bit bytes.

    With ``by_space`` a text is cut at spaces and each distinct piece is encoded once: the same
    ids, at half the time, for byte-level tokenizers that split before single spaces and line
    feeds and add no space of their own. Others are refused there.
    """

    def __init__(self, path: str, by_space: bool):
        # A task is one thread; the library would start one per core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_space, self.known = by_space, {}
        # Bytes a token stands for: a byte-level vocabulary writes each as one character.
        tokens = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(tokens.values(), default=0) + 1, np.int64)
        for token, k in tokens.items():
            self.bytes[k] = len(token)

    def _encoded(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _joined(self, pieces: Sequence[str]) -> list[bytes]:
        """Ids of pieces that may stand one behind the other, encoded as one text and cut by bytes."""
        if not pieces:
            return []
        ids = self._encoded(["".join(pieces)])[0]
        ends = np.cumsum(self.bytes[np.frombuffer(ids, "<u4")])
        wanted = np.cumsum(pc.binary_length(pa.array(pieces, pa.string())).to_numpy().astype(np.int64))
        cuts = np.searchsorted(ends, wanted)
        if cuts[-1] + 1 != len(ends) or (ends[cuts] != wanted).any():
            raise ValueError("this tokenizer's ids don't follow the bytes of the text: use by_space=False")
        cuts = (4 * (cuts + 1)).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _learn(self, new: Sequence[str]) -> None:
        # Pieces without white space of their own at either end can stand one behind the other.
        plain = [p for p in new if p and not (p[0].isspace() or p[-1].isspace())]
        lines = [p for p in new if len(p) > 1 and p[0] == "\n" and not (p[1].isspace() or p[-1].isspace())]
        spaced = [" " + p for p in plain] + lines
        plain += lines
        self.known.update(zip(plain, self._joined(spaced), strict=True))
        rest = [p for p in new if p not in self.known]
        self.known.update(zip(rest, self._encoded([p if p[:1] == "\n" else " " + p for p in rest]), strict=True))

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        if not self.by_space:
            return [x for t in texts for x in self._encoded([t])]
        found: list[bytes] = [b""] * len(texts)
        odd = [_odd(t) for t in texts]
        for kind in (False, True):
            some = [k for k, x in enumerate(odd) if x == kind]
            if some:
                for k, ids in zip(some, self._by_piece(_pieces([texts[k] for k in some], kind)), strict=True):
                    found[k] = ids
        return found

    def _by_piece(self, cut: pa.ListArray) -> list[bytes]:
        """Ids of texts in pieces: each distinct piece is looked up once, then ids are gathered."""
        ends = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        heads = cut.values.take(pa.array(ends[:-1])).to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn([p for p in distinct if p not in self.known])
        ids = [*map(self.known.__getitem__, distinct), *self._encoded(heads)]
        codes[ends[:-1]] = len(distinct) + np.arange(len(heads))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        many = sizes[codes]
        after = np.cumsum(many)
        gathered = np.frombuffer(b"".join(ids), "<u4")[np.arange(after[-1]) + np.repeat(starts[codes] - (after - many), many)]
        bounds = np.append(0, after)[ends].tolist()
        return [gathered[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str, by_space: bool) -> Encoder:
    return Encoder(path, by_space)


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    kind: str = "byte",
    block_ids: int = BLOCK_IDS,
    file_ids: int = FILE_IDS,
    level: int = LEVEL,
    by_space: bool = True,
) -> str:
    """Write the ids of every text, each followed by ``end_id``, under ``path`` in ascending order of id.

    NULL counts as an empty text: its end id only. Rows without an id come first; rows of one id
    stand in an order that depends on their texts alone. ``tokenizer`` is the path of a JSON file
    of the ``tokenizers`` library that every executor can open.
    """
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, slice_ = _encoder(tokenizer, by_space), TaskContext.get().partitionId()
        number, file = 0, None

        def done(file: Writer) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file.whole()], pa.binary())], ["content"])

        for batch in batches:
            for ids, texts in _some(batch):
                for id_, found in zip(ids, encode(texts), strict=True):
                    file = file or Writer(slice_, number, kind, block_ids, level)
                    file.add(id_, found + end)
                    if file.ids >= file_ids:
                        yield done(file)
                        number, file = number + 1, None
        if file:
            yield done(file)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("t"))
    # The last key only cuts what is equal otherwise, so that no id has to fit one slice.
    order = ["id", F.xxhash64("t"), F.col("arrival")]
    rows = rows.withColumn("arrival", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t")
    files = rows.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    return path


def _some(batch: pa.RecordBatch, most: int = 1 << 23) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, some MB at a time."""
    ids, texts, size = [], [], 0
    for id_, text in zip(*batch.columns, strict=True):
        ids.append(id_.as_py())
        texts.append((text.as_py() or b"").decode("utf-8", "replace"))
        size += len(texts[-1])
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Reader]:
    for batch in batches:
        for content in batch.column(0):
            # The writer ends a row with a line feed; a task without rows leaves an empty file.
            whole = content.as_py()[:-1]
            if whole:
                yield Reader(whole)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file in _opened(batches):
        checks = []
        for _, _, start, n in file.documents.tolist():
            check = 0
            for ids in file.stretch(start, n):
                check = zlib.crc32(ids.tobytes(), check)
            checks.append(check)
        d = file.documents
        columns = [
            pa.array(np.full(len(d), file.slice, np.int32)), pa.array(np.full(len(d), file.number, np.int32)),
            pa.array(d["id"].astype(np.int64), mask=d["known"] == 0), pa.array(d["start"].astype(np.int64)),
            pa.array(d["ids"].astype(np.int64)), pa.array(checks, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "number", "id", "start", "n", "check"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files under ``path``.

    ``start`` counts the ids of all documents before; the checksum is that of the ids as
    unsigned 32-bit numbers, little-endian, unpacked from their planes.
    """
    found = _files(spark, path).mapInArrow(_read, "slice int, number int, id long, start long, n long, check long")
    found = staged(found, "planes-read")
    files = found.groupBy("slice", "number").agg(F.sum("n").alias("ids"))
    slices = files.groupBy("slice").agg(F.sum("ids").alias("ids"))
    # One row per slice, that is per task that wrote; files are summed up inside their slice.
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before_slice"))
    inside = Window.partitionBy("slice").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("slice", "number", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("before_file"))
    joined = found.join(files.join(slices, "slice"), ["slice", "number"])
    start = (F.col("before_slice") + F.col("before_file") + F.col("start")).alias("start")
    return joined.select(F.col("id").alias("doc_id"), start, F.col("n").alias("n_tokens"), F.col("check").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of the documents in the files under ``path``, ids as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in _opened(batches):
            rows, size = [], 0
            for known, id_, start, n in file.documents.tolist():
                rows.append((id_ if known else None, np.concatenate([*file.stretch(start, n), np.zeros(0, "<u4")]).astype(np.int64)))
                size += n
                if size >= 1 << 20:
                    yield listed(rows)
                    rows, size = [], 0
            if rows:
                yield listed(rows)

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        ids, arrays = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(arrays, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _files(spark, path).mapInArrow(run, "doc_id long, ids array<long>")


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Texts written as files of token ids and read back: one row per row of ``docs``.

    See ``write_ids`` for NULLs, empty texts and repeated ids. An empty table gives an empty one.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    return read_documents(spark, write_ids(docs, work_path(spark, "token-planes"), tokenizer, id_col, text_col, **options))


__all__ = ["Encoder", "Reader", "Writer", "encoded", "ids_of", "planes_of", "read_documents", "read_ids", "write_ids"]
