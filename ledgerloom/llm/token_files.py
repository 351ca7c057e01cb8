"""Token files: encoding documents in doc_id order into patched frame-of-reference blocks, and reading them back.

File layout (little-endian), one file a shard of documents:

    magic "LLPFOR1\\0", n_docs u64, n_tokens u64, n_blocks u64
    doc_ids i64[n_docs], ends u64[n_docs]         tokens up to the end of each document
    index u64[n_blocks + 1]                        byte offsets of the blocks from the start of the block area
    blocks: base u32, width u8, pad u8, exceptions u16,
            packed values (BLOCK * width bits, low bits first), exception places u16[], exception values u32[]

A block holds BLOCK = 256 ids (the last one is filled up with its base). The block's minimum is subtracted, the width is the smallest one that
holds the ``percentile`` share of the differences, and the rest are kept whole in the exception list. Blocks with one
width are packed and unpacked in one vectorised step, at most ``RUN`` blocks at a time; a writer holds packed bytes and one
such run of ids. The index makes any block readable alone.

Files are written by the executors to a URI that all of them share, under a name made of the attempt, and moved
into place when whole, so a repeated task replaces its own file.

Defined cases: null and empty text is a document of the end id alone; a null doc_id sorts first and is stored as the
smallest 64-bit integer; rows that repeat a doc_id stay separate documents, ordered by text; an empty table writes no
files and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import Encoder, vocabulary_path
from .packed import Slice, batch_slices
from .runtime import bucket_count, fresh_dir, read, release, settle

MAGIC = b"LLPFOR1\0"
BLOCK = 256
RUN = 1024  # blocks packed or unpacked at a time
END = 2
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<8sQQQ")


def _widths(diff: np.ndarray, percentile: float) -> np.ndarray:
    """Bits that hold the given share of each block's values."""
    rank = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    value = np.partition(diff, rank, axis=1)[:, rank]
    return np.ceil(np.log2(value.astype(np.float64) + 1)).astype(np.uint8)


def _pack_run(ids: np.ndarray, percentile: float) -> list[bytes]:
    """The blocks of at most ``RUN`` blocks' worth of ids."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    full = full.reshape(n, BLOCK)
    base = full.min(axis=1)
    diff = full - base[:, None]
    width = _widths(diff, percentile)
    out: list[bytes] = [b""] * n
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        part = diff[rows]
        over = part >> np.uint32(w) != 0 if w < 32 else np.zeros(part.shape, bool)
        bits = np.unpackbits(np.where(over, 0, part).astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        row, place = np.nonzero(over)
        first = np.searchsorted(row, np.arange(len(rows) + 1))
        value = part[row, place].astype("<u4")
        place = place.astype("<u2")
        for k, r in enumerate(rows):
            i, j = first[k], first[k + 1]
            out[r] = struct.pack("<IBBH", int(base[r]), int(w), 0, int(j - i)) + packed[k].tobytes() + place[i:j].tobytes() + value[i:j].tobytes()
    return out


def pack_blocks(ids: np.ndarray, percentile: float = 98.0) -> tuple[np.ndarray, bytes]:
    """(index, block area) of an array of ids below 2**32."""
    blocks = [b for i in range(0, len(ids), RUN * BLOCK) for b in _pack_run(ids[i : i + RUN * BLOCK], percentile)]
    index = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=index[1:])
    return index, b"".join(blocks)


def _unpack_run(index: np.ndarray, area: np.ndarray) -> np.ndarray:
    n = len(index) - 1
    at = (index - index[0]).astype(np.int64)[:-1]
    word = lambda offset, size, kind: area[at[:, None] + offset + np.arange(size)].view(kind)[:, 0]
    out = np.zeros((n, BLOCK), np.uint32)
    base, width, many = word(0, 4, "<u4"), area[at + 4], word(6, 2, "<u2").astype(np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        size = BLOCK * int(w) // 8
        if w:
            bits = np.unpackbits(area[at[rows][:, None] + 8 + np.arange(size)], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            pad = np.zeros((len(rows), BLOCK, 32), np.uint8)
            pad[:, :, :w] = bits
            out[rows] = np.packbits(pad, axis=2, bitorder="little").view("<u4")[:, :, 0]
        if k := many[rows].sum():
            row = np.repeat(rows, many[rows])
            nth = np.arange(k) - np.repeat(np.cumsum(many[rows]) - many[rows], many[rows])
            place = area[(at[row] + 8 + size + 2 * nth)[:, None] + np.arange(2)].view("<u2")[:, 0]
            value = area[(at[row] + 8 + size + 2 * many[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
            out[row, place] = value
    out += base[:, None]
    return out.reshape(-1)


def unpack_blocks(index: np.ndarray, area: np.ndarray, n_tokens: int) -> np.ndarray:
    """The ids of consecutive blocks: ``index`` has their starts and the end, ``area`` begins at the first of them."""
    out = np.zeros(n_tokens, np.uint32)
    for i in range(0, len(index) - 1, RUN):
        part = index[i : i + RUN + 1]
        lo, hi = (int(x - index[0]) for x in (part[0], part[-1]))
        begin = i * BLOCK
        size = min(n_tokens - begin, (len(part) - 1) * BLOCK)
        out[begin : begin + size] = _unpack_run(part, area[lo:hi])[:size]
    return out


class FileBuilder:
    """One file in the making: ids are packed as soon as a run of blocks is full, so only packed bytes and a run are held."""

    def __init__(self, percentile: float):
        self.percentile = percentile
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.blocks: list[bytes] = []
        self.tail: list[np.ndarray] = []
        self.waiting = self.n_tokens = 0

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.sizes.append(sizes)
        self.n_tokens += len(ids)
        run = RUN * BLOCK
        while self.waiting + len(ids) >= run:
            take = run - self.waiting
            self.blocks += _pack_run(np.concatenate((*self.tail, ids[:take])), self.percentile)
            self.tail, self.waiting, ids = [], 0, ids[take:]
        if len(ids):
            self.tail.append(ids.copy())
            self.waiting += len(ids)

    def finish(self) -> tuple[bytes, int, int]:
        """(file, documents, ids)"""
        if self.waiting:
            self.blocks += _pack_run(np.concatenate(self.tail), self.percentile)
        doc_ids, ends = np.concatenate(self.docs), np.cumsum(np.concatenate(self.sizes))
        index = np.zeros(len(self.blocks) + 1, "<u8")
        np.cumsum([len(b) for b in self.blocks], out=index[1:])
        head = _HEAD.pack(MAGIC, len(doc_ids), self.n_tokens, len(self.blocks))
        return b"".join((head, doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), index.tobytes(), *self.blocks)), len(doc_ids), self.n_tokens


def parse_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ends, index, block area)"""
    magic, docs, tokens, blocks = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    ends = np.frombuffer(data, "<u8", docs, at + 8 * docs)
    index = np.frombuffer(data, "<u8", blocks + 1, at + 16 * docs)
    return doc_ids, ends, index, np.frombuffer(data, np.uint8, offset=at + 16 * docs + 8 * (blocks + 1))


def store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all."""
    files, path = store(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 0}.part"
    with files.open_output_stream(part) as f:
        f.write(data)
    files.move(part, path)


def _writer(folder: str, vocabulary: str, end: int, percentile: float, file_tokens: int):
    def run(batches):
        encoder = Encoder(vocabulary)
        part, n = TaskContext.get().partitionId(), 0
        made = FileBuilder(percentile)

        def flush(made: FileBuilder, n: int):
            name = f"{part:06d}-{n:06d}.tok"
            data, n_docs, n_tokens = made.finish()
            put(f"{folder}/{name}", data)
            return pa.RecordBatch.from_pydict({"file": pa.array([name]), "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

        for batch in batches:
            for ids, lens, buf in batch_slices(batch.column(0), batch.column(1)):
                tokens, sizes = encoder.encode(Slice(ids, lens, buf))
                made.add(ids, sizes + 1, np.insert(tokens, np.cumsum(sizes), end))
                if made.n_tokens >= file_tokens:
                    yield flush(made, n)
                    made, n = FileBuilder(percentile), n + 1
        if made.docs:
            yield flush(made, n)
        del encoder, made
        release()

    return run


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end: int = END, percentile: float = 98.0, file_tokens: int = 4 << 20) -> DataFrame:
    """Write ``docs`` in ascending doc_id order to ``folder``; returns (file, n_docs, n_tokens, start), written out."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = bucket_count(docs) // 2
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = settle(ordered.mapInArrow(_writer(folder, vocabulary, end, percentile, file_tokens), "file string, n_docs long, n_tokens long"), large=True)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return settle(files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))))


def _reader(batches):
    for batch in batches:
        for name, data in zip(batch.column(0), batch.column(1), strict=True):
            doc_ids, ends, index, area = parse_file(data.as_py())
            raw, begin = memoryview(unpack_blocks(index, area, int(ends[-1]) if len(ends) else 0).astype("<u4", copy=False)), np.concatenate(([0], ends[:-1])).astype(np.int64)
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(begin, ends.astype(np.int64), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID),
                "name": pa.array([name.as_py()] * len(ends), pa.string()),
                "inside": pa.array(begin, pa.int64()),
                "n_tokens": pa.array(ends.astype(np.int64) - begin, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            })


def read_tokens(spark, folder: str, files: DataFrame) -> DataFrame:
    """A row a document of the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if files.isEmpty():
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").load(f"{folder}/*.tok").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    found = found.mapInArrow(_reader, "doc_id long, name string, inside long, n_tokens long, ids_crc32 long")
    found = found.join(files.select("file", "start"), F.col("name") == F.col("file"))
    return found.select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write the token files of ``docs`` to a new shared folder and read them back."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")
    files = write_tokens(docs, folder, vocabulary or vocabulary_path(), end)
    return read_tokens(spark, folder, files)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    return token_table(read(spark, sf_dir, "documents"))
