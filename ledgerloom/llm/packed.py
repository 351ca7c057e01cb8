"""Packed text: documents in slices of about a megabyte, and vectorised words, hashes and rolling windows over them.

A slice row is (sid, ids, lens, body): little-endian int64 doc_ids, int32 byte lengths (-1: null text) and the
zstd-compressed UTF-8 of the texts, each followed by one newline. Slices are written once (a checkpoint), so that
messages between slices and hash buckets can name a word by its place in the slice and need not carry positions.
``NULL_ID`` stands for a null doc_id; it sorts last and comes back as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import dealt, release, settle

SLICE_BYTES = 1 << 20
SLICE_DOCS = 1 << 20
KEPT_POWERS = 3 * SLICE_BYTES // 2
NULL_ID = (1 << 63) - 1
SLICE_SCHEMA = "sid long, ids binary, lens binary, body binary"

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x = x * _M2
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Prefix-summed polynomial hash modulo 2**64 with an odd base, so that any span's hash is one subtraction and one product."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, (1 << 63) - 1)) * 8 + 5 & (1 << 64) - 1
        self.bytes = rng.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.kept: dict[int, np.ndarray] = {}

    def powers(self, n: int, base: int) -> np.ndarray:
        """base ** 0 to base ** (n - 1). Tables are kept for later slices up to ``KEPT_POWERS`` entries; a longer text makes its own."""
        table = self.kept.get(base)
        if table is None or len(table) < n:
            table = np.full(n if n > KEPT_POWERS else min(1 << (n - 1).bit_length(), KEPT_POWERS), base, np.uint64)
            table[0] = 1
            np.cumprod(table, out=table)
            if len(table) <= KEPT_POWERS:
                self.kept[base] = table
        return table[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        if len(values):
            np.cumsum(values * self.powers(len(values), self.base), out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        return mix((prefix[end] - prefix[start]) * self.powers(len(prefix), self.inverse)[start])


WORDS, FIRST, SECOND = Rolling(11), Rolling(23), Rolling(37)


class Slice:
    """Words of a slice. Word arrays run over all documents; document d has words first[d] to first[d + 1]."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, buf: np.ndarray, fold: np.ndarray | None = None):
        self.ids, self.lens = ids, lens
        self.raw = buf
        self.buf = buf if fold is None else np.frombuffer(buf.tobytes().translate(fold.tobytes()), np.uint8)
        self.byte = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(np.maximum(lens, 0) + 1, out=self.byte[1:])
        word = np.concatenate(([False], (self.buf != 0x20) & (self.buf - np.uint8(0x09) > np.uint8(0x0D - 0x09))))  # below 0x09 it wraps round
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.byte)
        self.count = np.diff(self.first)

    def word_hash(self) -> np.ndarray:
        return WORDS.spans(WORDS.prefix(WORDS.bytes[self.buf]), self.start, self.end)

    def position(self) -> np.ndarray:
        """Of each word in its document."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)

    def windows(self, k: int) -> np.ndarray:
        """Indexes of the words that begin a window of k words of one document."""
        return np.flatnonzero(np.repeat(self.count, self.count) - self.position() >= k)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    @classmethod
    def of(cls, row: dict, fold: np.ndarray | None = None) -> "Slice":
        buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
        return cls(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lens"], "<i4"), buf, fold)


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, bytes and nulls of a string column."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, data, np.asarray(column.is_null())


def id_column(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(NULL_ID), np.int64)


def cuts(lens: np.ndarray, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes; a longer document is a run of its own."""
    total = np.cumsum(np.maximum(lens, 0) + 1)
    out, i = [], 0
    while i < len(lens):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right"))
        j = min(max(j, i + 1), i + SLICE_DOCS)
        out.append((i, j))
        i = j
    return out


def joined(at: np.ndarray, data: np.ndarray, lens: np.ndarray, i: int, j: int) -> np.ndarray:
    """Bytes of texts i to j, a newline after each."""
    part, size = data[at[i] : at[j]], np.maximum(lens[i:j], 0)
    out = np.full(len(part) + (j - i), 10, np.uint8)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(size + 1) - 1] = False
    out[keep] = part
    return out


def batch_slices(ids: pa.Array, texts: pa.Array):
    """(ids, lens, buffer) of each run of documents of an Arrow batch."""
    at, data, null = text_column(texts)
    lens = np.diff(at).astype(np.int32)
    key = id_column(ids)
    for i, j in cuts(lens):
        buf = joined(at, data, lens, i, j)
        yield key[i:j], np.where(null[i:j], -1, lens[i:j]).astype(np.int32), buf
    release()


def _pack(batches):
    n, part = 0, TaskContext.get().partitionId()
    zip_ = zstandard.ZstdCompressor(level=1)
    held, held_bytes = [], 0

    def row():
        nonlocal n
        ids, lens, bufs = (np.concatenate(x) for x in zip(*held, strict=True))
        n += 1
        return pa.RecordBatch.from_pydict({"sid": pa.array([(part << 20) + n - 1], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "lens": pa.array([lens.tobytes()], pa.binary()), "body": pa.array([zip_.compress(bufs.tobytes())], pa.binary())})

    for batch in batches:
        for piece in batch_slices(batch.column(0), batch.column(1)):
            if held and held_bytes + len(piece[2]) > SLICE_BYTES:
                yield row()
                held, held_bytes = [], 0
            held.append(piece)
            held_bytes += len(piece[2])
    if held:
        yield row()


def pack(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Slices of ``docs`` (doc_id, text), written to the shared folder; with ``parts``, dealt to so many partitions by ``sid``."""
    slices = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack, SLICE_SCHEMA)
    return settle(slices) if parts is None else dealt(slices, "sid", parts)


def rows(batches, arrays: tuple[str, ...] = ()):
    """Rows of Arrow batches as dicts, one batch row at a time; the lists of ``arrays`` as arrays."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {n: batch.column(c)[i].values.to_numpy(zero_copy_only=False) if n in arrays else batch.column(c)[i].as_py() for c, n in enumerate(names)}


def by_bucket(bucket: np.ndarray, buckets: int):
    """(order, bounds): order[bounds[b]:bounds[b + 1]] are the entries of bucket b, first to last."""
    small = bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket  # sorted by radix
    return np.argsort(small, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def messages(sid: int, bucket: np.ndarray, buckets: int, **values: np.ndarray) -> pa.RecordBatch | None:
    """One row a bucket that has entries: their values, in the order of the slice. Bits are packed."""
    order, bounds = by_bucket(bucket, buckets)
    used = np.flatnonzero(np.diff(bounds))
    out = {"sid": pa.array(np.full(len(used), sid), pa.int64()), "bucket": pa.array(used, pa.int32())}
    for name, v in values.items():
        v = v[order]
        out[name] = pa.array([(np.packbits(x) if x.dtype == bool else x).tobytes() for x in (v[bounds[b] : bounds[b + 1]] for b in used)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def replies(bucket: np.ndarray, buckets: int, answers: list[dict] | None, dtype) -> np.ndarray:
    """What the buckets answered for each entry, back in the order of the slice."""
    out = np.zeros(len(bucket), dtype)
    order, bounds = by_bucket(bucket, buckets)
    for a in answers or ():
        at = order[bounds[a["bucket"]] : bounds[a["bucket"] + 1]]
        got = np.frombuffer(a["reply"], np.uint8)
        out[at] = np.unpackbits(got, count=len(at)).astype(bool) if dtype is bool else got.view(dtype)
    return out


def column_parts(table: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype) for x in table.column(name)]


def answer(table: pa.Table, parts: list[np.ndarray]) -> pa.Table:
    return pa.table({"sid": table.column("sid"), "bucket": table.column("bucket"), "reply": pa.array([(np.packbits(p) if p.dtype == bool else p).tobytes() for p in parts], pa.binary())})


def frequency(table: pa.Table) -> pa.Table:
    """A byte a fingerprint: 0 for a count of one, else growing with the count (6 steps a doubling)."""
    parts = column_parts(table, "prints", np.uint32)
    prints = np.concatenate(parts)
    key = np.sort(prints.astype(np.uint64) << np.uint64(32) | np.arange(len(prints), dtype=np.uint64))  # faster than by indexes
    order, sorted_ = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), key >> np.uint64(32)
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    count = np.diff(np.append(np.flatnonzero(new), len(prints)))
    code = np.where(count == 1, 0, np.minimum(255, np.floor(6 * np.log2(count)))).astype(np.uint8)
    out = np.empty(len(prints), np.uint8)
    out[order] = np.repeat(code, count)
    return answer(table, np.split(out, np.cumsum([len(p) for p in parts])[:-1]))


ANSWER_SCHEMA = "sid long, bucket int, reply binary"


def by_slice(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("sid").agg(F.collect_list(F.struct("bucket", "reply")).alias(name))
