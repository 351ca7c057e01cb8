"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Texts are lower-cased and cut into words at everything ASCII that is neither letter nor digit. An item is its weighted
set of ``shingle``-word shingles (weight: how often it occurs); items with fewer words are one shingle. A window of
a document is as many words as the item has; a document with fewer words that shares a shingle is one window, verified
by the exact cosine whatever its fingerprint (of few shingles a fingerprint says little). Every other window that shares a shingle
with any item of its size gets a 512-bit SimHash of its weighted shingles (windows that share none have similarity 0 and need no fingerprint).

Fingerprints are split into 64 blocks of a byte. Each table, one a block, is probed with the 37 values within ``flips`` = 2 bits of the
window's, and an item met in a block has a vote of it. A block without a vote has at least 3 bits that differ, so an item within ``radius`` = 131
bits lacks at most 131 // 3 = 43 votes: all items within the radius have 21 votes or more. An unrelated fingerprint has about 9, and 21 or more
in less than 1 % of cases for items of 14 words or more (tested); of windows with similarity 0.8, which differ by 105 bits on average (standard deviation 9), 99.8 % lie in the radius
(tested for 0.99). Items with enough votes are held against the radius, then verified by the exact cosine of the weighted shingle sets.

Items go to the executors in blocks of at most ``ITEM_BYTES`` of text, one pass over the documents a block, so no broadcast
grows with the benchmark. Windows get their fingerprints from running votes, so neither work nor memory grows with windows
times words of an item. Documents need no shuffle before their (few) hits; work is a rolling hash and a table
look-up a word.

Defined cases: null and empty texts match nothing; items without words are skipped; null item_ids stay null; repeated
items or documents each report; of many windows of one item in one document row the most similar, then the first one is
reported; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import FIRST, NULL_ID, Slice, batch_slices, mix
from .runtime import read

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 131
FLIPS = 2
ITEM_BYTES = 4 << 20
RUN = 1 << 15
VOTES = 1 << 18
RESULT_SCHEMA = "doc_id long, item_id long, start long, n_words int, distance int, similarity double"

_SALTS = [np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for j in range(8)]  # one for each 64 bits of a fingerprint
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[10] = 10


def _folded(ids: np.ndarray, lens: np.ndarray, buf: np.ndarray) -> Slice:
    """Words of a slice, lower case beyond ASCII too (texts whose length in bytes would change are rebuilt)."""
    if buf.max(initial=0) > 127:
        raw = buf.tobytes()
        low = raw.decode("utf-8", "replace").lower().encode()
        if len(low) == len(raw):
            buf = np.frombuffer(low, np.uint8)
        else:
            ends = np.cumsum(np.maximum(lens, 0) + 1)
            parts = [raw[e - n - 1 : e - 1].decode("utf-8", "replace").lower().encode() for e, n in zip(ends, np.maximum(lens, 0), strict=True)]
            lens = np.where(lens < 0, -1, [len(p) for p in parts]).astype(np.int32)
            buf = np.frombuffer(b"".join(p + b"\n" for p in parts), np.uint8)
    return Slice(ids, lens, buf, _FOLD)


def _shingles(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hash at each word (0 where none begins), and which words begin one."""
    h = s.word_hash()
    prefix = FIRST.prefix(h)
    at = s.windows(k)
    out, begins = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    out[at], begins[at] = FIRST.spans(prefix, at, at + k), True
    return out, begins


def _bits(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    return np.unpackbits(mix(hashes ^ salt).astype("<u8").view(np.uint8).reshape(*hashes.shape, 8), axis=-1)


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Eight words of 64 bits of each row of shingle hashes: a bit is set where the weighted sum of +1 and -1 by that bit of the salted hashes is positive."""
    votes = (_bits(hashes, salt).sum(axis=-2, dtype=np.int32) * 2 - hashes.shape[-1] for salt in _SALTS)
    return np.stack([np.packbits(v > 0, axis=-1).view("<u8")[..., 0] for v in votes], axis=-1)


def rolling_simhash(h: np.ndarray, start: np.ndarray, w: int) -> np.ndarray:
    """SimHash of the w shingles from each of some ascending places, by differences of running votes."""
    first = int(start[0])
    at, out = start - first, np.zeros((len(start), len(_SALTS)), "<u8")
    for j, salt in enumerate(_SALTS):
        bits = _bits(h[first : int(start[-1]) + w], salt)
        votes = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=votes[1:])
        out[:, j] = np.packbits(2 * (votes[at + w] - votes[at]) > w, axis=1).view("<u8")[:, 0]
    return out


def _near(width: int, most: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``most`` bits set."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in itertools.combinations(range(width), n)], np.uint8)


class ItemIndex:
    """Items by word count, each with shingles and SimHash, with a table of items by value for each block of the fingerprints."""

    def __init__(self, items: list[tuple[int | None, str]], shingle: int = SHINGLE, radius: int = RADIUS, flips: int = FLIPS):
        self.blocks = 8 * len(_SALTS)
        self.shingle, self.radius, self.need = shingle, radius, self.blocks - radius // (flips + 1)
        if self.need < 1:
            raise ValueError(f"blocks of 8 bits within {flips} tell nothing of a radius of {radius}")
        texts = pa.array([t for _, t in items], pa.string())
        self.ids: list[int | None] = []
        rows: list[np.ndarray] = []
        self.size: list[int] = []
        done = 0
        for ids, lens, buf in batch_slices(pa.array(range(len(items)), pa.int64()), texts):
            s = _folded(ids, lens, buf)
            for d in range(len(ids)):
                n = int(s.count[d])
                if n:
                    k = min(shingle, n)
                    h, begins = _shingles(Slice(ids[d : d + 1], s.lens[d : d + 1], s.buf[s.byte[d] : s.byte[d + 1]]), k)
                    self.ids.append(items[done + d][0])
                    self.size.append(n)
                    rows.append(h[begins])
            done += len(ids)
        self.rows = rows
        self.prints = np.array([simhash(r) for r in rows], "<u8").reshape(-1, len(_SALTS))
        self.weights = [np.unique(r, return_counts=True) for r in rows]
        self.norms = [float(np.sqrt((c.astype(np.float64) ** 2).sum())) for _, c in self.weights]
        self.by_size: dict[int, np.ndarray] = {n: np.flatnonzero(np.array(self.size) == n) for n in sorted(set(self.size))}
        self.seeds = {k: np.unique(np.concatenate([r for r, n in zip(rows, self.size, strict=True) if min(n, shingle) == k])) for k in sorted({min(n, shingle) for n in self.size})}
        self.seeds_of = {n: np.unique(np.concatenate([rows[m] for m in members])) for n, members in self.by_size.items()}
        self.filters = {}
        for k, seeds in self.seeds.items():
            table = np.zeros(1 << 20, bool)
            table[seeds >> np.uint64(44)] = True
            self.filters[k] = table
        self.near = _near(8, flips)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each size: items by value of each block, and where each value begins
        self.holders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # of each size: shingles in order, the item and the weight of each
        for n, members in self.by_size.items():
            part = np.ascontiguousarray(self.prints[members].view(np.uint8).T)
            order = np.argsort(part, axis=1, kind="stable").astype(np.int32)
            begin = np.stack([np.searchsorted(np.sort(x), np.arange(257)) for x in part]).astype(np.min_scalar_type(len(members)))
            self.tables[n] = order, begin
            held = np.concatenate([self.weights[m][0] for m in members])
            at = np.argsort(held, kind="stable")
            owner = np.repeat(np.arange(len(members), dtype=np.int32), [len(self.weights[m][0]) for m in members])
            self.holders[n] = held[at], owner[at], np.concatenate([self.weights[m][1] for m in members])[at]

    def voted(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item of n words) with as many votes of blocks as any pair within the radius has, by place in ``prints`` and in ``by_size``."""
        order, begin = self.tables[n]
        many, base = order.shape[1], np.arange(self.blocks)[None, :, None] * 257
        begin, step, found = begin.ravel(), max(1, min(256, VOTES // many)), []
        for i in range(0, len(prints), step):
            value = np.ascontiguousarray(prints[i : i + step]).view(np.uint8)
            place = (base + (value[:, :, None] ^ self.near)).ravel()
            lo, hi = begin[place], begin[place + 1]
            hit = np.flatnonzero(hi > lo)
            lo, size = lo[hit].astype(np.int64), (hi[hit] - lo[hit]).astype(np.int64)
            block = hit // len(self.near)
            at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            item = order[np.repeat(block % self.blocks, size), at]
            votes = np.bincount(np.repeat(block // self.blocks * many, size) + item, minlength=len(value) * many)
            pair = np.flatnonzero(votes >= self.need)
            found.append((pair // many + i, pair % many))
        return np.concatenate([t for t, _ in found]), np.concatenate([m for _, m in found])

    def candidates(self, n: int, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(fingerprint, item of n words, distance) of all pairs within the radius: those with enough votes, then the whole distance."""
        t, m = self.voted(n, prints)
        m = self.by_size[n][m]
        distance = np.bitwise_count(prints[t] ^ self.prints[m]).sum(axis=1, dtype=np.int64)
        near = distance <= self.radius
        return list(zip(t[near].tolist(), m[near].tolist(), distance[near].tolist(), strict=True))

    def cosine(self, m: int, window: np.ndarray) -> float:
        seen, count = np.unique(window, return_counts=True)
        mine, weight = self.weights[m]
        at = np.minimum(np.searchsorted(mine, seen), len(mine) - 1)
        both = mine[at] == seen
        return float((count[both] * weight[at[both]]).sum() / (self.norms[m] * np.sqrt((count.astype(np.float64) ** 2).sum())))

    def search(self, s: Slice, threshold: float):
        """(document, item, first word, words, distance, similarity) of the best window of each item in each document."""
        best: dict[tuple[int, int], tuple] = {}
        for k, seeds in self.seeds.items():
            h, begins = _shingles(s, k)
            hit = np.flatnonzero(begins & self.filters[k][h >> np.uint64(44)])
            hit = hit[np.isin(h[hit], seeds)]
            if not len(hit):
                continue
            for n in [n for n in self.by_size if min(n, self.shingle) == k]:
                mine = hit[np.isin(h[hit], self.seeds_of[n])]  # windows that share no shingle with an item of this size have similarity 0
                if not len(mine):
                    continue
                w = n - k + 1  # shingles of a window
                self.search_short(s, h, mine, n, k, threshold, best)
                turn = np.zeros(len(h) + 1, np.int64)  # windows that hold a hit begin at most w - 1 words before it
                np.add.at(turn, np.maximum(mine - w + 1, 0), 1)
                np.add.at(turn, mine + 1, -1)
                start = np.flatnonzero(np.cumsum(turn[:-1]) > 0)
                home = np.searchsorted(s.first, start, "right") - 1
                inside = start + n <= s.first[np.minimum(home + 1, len(s.first) - 1)]
                start, home = start[inside], home[inside]
                i = 0
                while i < len(start):
                    j = int(np.searchsorted(start, start[i] + RUN))  # windows within RUN words
                    for t, m, apart in self.candidates(n, rolling_simhash(h, start[i:j], w)):
                        at, d = int(start[i + t]), int(home[i + t])
                        c = self.cosine(m, h[at : at + w])
                        if c >= threshold - 1e-12:
                            mark = (-c, at - int(s.first[d]), n, apart, c)
                            if (d, m) not in best or mark < best[d, m]:
                                best[d, m] = mark
                    i = j
        return [(d, m, x[1], x[2], x[3], x[4]) for (d, m), x in best.items()]

    def search_short(self, s: Slice, h: np.ndarray, hits: np.ndarray, n: int, k: int, threshold: float, best: dict[tuple[int, int], tuple]) -> None:
        """Documents shorter than items of n words and with a shingle of one: the whole document is the window, its products with all items summed over their shared shingles."""
        members, (held, owner, weight) = self.by_size[n], self.holders[n]
        norms = np.array([self.norms[m] for m in members])
        for d in np.unique(np.searchsorted(s.first, hits, "right") - 1).tolist():
            words = int(s.count[d])
            if words >= n:
                continue
            row = h[int(s.first[d]) : int(s.first[d]) + words - k + 1]
            seen, count = np.unique(row, return_counts=True)
            lo, size = np.searchsorted(held, seen), np.searchsorted(held, seen, "right")
            size -= lo
            at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            product = np.bincount(owner[at], np.repeat(count, size) * weight[at], minlength=len(members))
            c = product / (norms * np.sqrt((count.astype(np.float64) ** 2).sum()))
            near = np.flatnonzero(c >= threshold - 1e-12)
            if len(near):
                apart = np.bitwise_count(self.prints[members[near]] ^ simhash(row)).sum(axis=1, dtype=np.int64)
                for m, x, y in zip(members[near].tolist(), apart.tolist(), c[near].tolist(), strict=True):
                    best[d, m] = (-y, 0, words, x, y)


def _searcher(index, threshold: float):
    def run(batches):
        items = index.value
        for batch in batches:
            for ids, lens, buf in batch_slices(batch.column(0), batch.column(1)):
                found = items.search(_folded(ids, lens, buf), threshold)
                if found:
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([None if ids[d] == NULL_ID else int(ids[d]) for d, *_ in found], pa.int64()),
                        "item_id": pa.array([items.ids[m] for _, m, *_ in found], pa.int64()),
                        "start": pa.array([x[2] for x in found], pa.int64()), "n_words": pa.array([x[3] for x in found], pa.int32()),
                        "distance": pa.array([x[4] for x in found], pa.int32()), "similarity": pa.array([x[5] for x in found], pa.float64()),
                    })

    return run


def item_blocks(benchmark: DataFrame, most: int = ITEM_BYTES):
    """The items in runs of about ``most`` bytes of text; the driver holds one run at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        if held and size + len(row[1].encode()) > most:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1].encode())
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, radius: int = RADIUS, flips: int = FLIPS) -> DataFrame:
    """A row for each document row and item of which it holds a window of at least ``threshold``: doc_id, item_id, start (word), n_words, distance, similarity."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], RESULT_SCHEMA)
    for items in item_blocks(benchmark):
        if not any(re.search(r"[^\W_]|[^\x00-\x7f]", t) for _, t in items):
            continue
        index = spark.sparkContext.broadcast(ItemIndex(items, shingle, radius, flips))
        out = out.unionByName(texts.mapInArrow(_searcher(index, threshold), RESULT_SCHEMA))
    return out


def _cleaner(index, threshold: float, at: int):
    def run(batches):
        items = index.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            done = 0
            for ids, lens, buf in batch_slices(pa.array(np.arange(batch.num_rows)), batch.column(at)):
                for d, *_ in items.search(_folded(ids, lens, buf), threshold):
                    keep[done + d] = False
                done += len(ids)
            yield batch.filter(pa.array(keep))

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, radius: int = RADIUS, flips: int = FLIPS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; one narrow pass a block of items, without a join."""
    out, at = docs.withColumn("text", F.col("text").cast("string")), docs.columns.index("text")
    for items in item_blocks(benchmark):
        if any(re.search(r"[^\W_]|[^\x00-\x7f]", t) for _, t in items):
            index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, shingle, radius, flips))
            out = out.mapInArrow(_cleaner(index, threshold, at), out.schema)
    return out


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
