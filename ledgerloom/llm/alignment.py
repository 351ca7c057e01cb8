"""Cross-tokenizer alignment: minimal groups of tokens of two tokenizers over the same bytes, and how often ids meet.

A encodes space + text with a byte-level vocabulary of the tokenizers library, B encodes the text with a sentencepiece
model that puts the space itself. An A and a B token are linked where their byte ranges overlap. Groups are the connected
components of this bipartite graph, found by union-find over the links; as both sequences cover the same bytes, they are
the shortest runs that begin and end together. The links of all components are expanded to id pairs and counted over the
corpus; a B id's best partners are those of its highest count.

Both tokenizers always start a token at a single space between two characters that are no white space (B's pieces have
spaces only at their start, or are spaces only; ``Pair`` checks that). So a text is cut there, and each distinct chunk of a
slice is encoded and aligned once, with a bounded cache. Counts, pairs and group strings of a document are sums and
concatenations over its chunks.

Defined cases: null and empty texts, and those whose joined token bytes differ from space + text (white space that B
changes, U+2581), have no tokens: zeros and an empty digest; they add nothing to the counts. Null and repeated doc_ids are
rows of their own; other columns are ignored; an empty table gives no rows.

Scale: slices (about ``SLICE_BYTES`` of text) send each distinct id pair once with its count and get each one's corpus-wide
count back, so a pair that is everywhere is a row a slice. There are at most as many pairs as products of ids, far fewer in
practice; they are joined with a broadcast below ``BROADCAST_ROWS`` counted rows, else by shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import _byte_letters, vocabulary_path
from .packed import WORDS, cuts, rows, text_column
from .runtime import bounded, read, settle

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_BYTES = 4 << 20
KEPT_BYTES = 96 << 20
BROADCAST_ROWS = 500_000

_ODD = np.zeros(256, bool)
_ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of all white space beyond ASCII, and of some other characters
_INK = np.zeros(256, bool)
_INK[0x21:0x7F] = True


class Pair:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte = {c: i for i, c in enumerate(_byte_letters())}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.cut_at_spaces = not any("▁" in p[1:] and set(p) != {"▁"} for p in pieces)

    def encode(self, chunks: list[bytes]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both for each chunk (it starts with the space), or None where the bytes of one differ."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        of_a = [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        of_b = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        same = lambda ids, table, chunk: b"".join(table[i] for i in ids) == chunk
        return [(x, y) if same(x, self.a_bytes, c) and same(y, self.b_bytes, c) else None for x, y, c in zip(of_a, of_b, chunks, strict=True)]


def components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union-find over links of ``n`` nodes: the least node of each one's component. All links at once: roots are hooked to lower roots, then paths are halved."""
    parent = np.arange(n)
    while True:
        x, y = parent[left], parent[right]
        if (x == y).all():
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != parent[parent]).any():
            parent = parent[parent]


def linked(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all overlapping pairs of two sequences that cover the same bytes; ends are ascending. Between two ends one token of each lies, and the next pair differs."""
    ends = np.union1d(a_end, b_end)
    return np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)


class Aligner:
    """Aligned chunks, kept by hash."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.reset()

    def reset(self):
        self.keys = np.zeros(0, np.uint64)
        self.numbers = np.zeros((0, 4), np.int32)  # A tokens, B tokens, groups, links; -1 where the bytes differ
        self.link_at, self.text_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text_size = np.zeros(0, np.int32)
        self.links, self.texts = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def bytes_held(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.numbers, self.link_at, self.text_at, self.text_size, self.links, self.texts))

    def learn(self, keys: np.ndarray, chunks: list[bytes]):
        numbers, links, texts = [], [], []
        for i in range(0, len(chunks), 4096):
            n, k, t = self.align(chunks[i : i + 4096])
            numbers.append(n), links.append(k), texts.extend(t)
        numbers, links = np.concatenate(numbers), np.concatenate(links)
        sizes = np.array([len(t) for t in texts], np.int32)
        n_links = np.maximum(numbers[:, 3], 0).astype(np.int64)
        order = np.argsort(all_keys := np.concatenate((self.keys, keys)), kind="stable")
        more = lambda held, at: np.concatenate((held, at))[order]
        self.keys, self.numbers = all_keys[order], more(self.numbers, numbers)
        self.link_at = more(self.link_at, len(self.links) + np.cumsum(n_links) - n_links)
        self.text_at = more(self.text_at, len(self.texts) + np.cumsum(sizes, dtype=np.int64) - sizes)
        self.text_size = more(self.text_size, sizes)
        self.links = np.concatenate((self.links, links))
        self.texts = np.concatenate((self.texts, np.frombuffer(b"".join(texts), np.uint8)))

    def align(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers, links (A id in the high half, B id in the low one) and group strings, each with a last `;`."""
        numbers = np.full((len(chunks), 4), -1, np.int32)
        texts = [b""] * len(chunks)
        ids = self.pair.encode(chunks)
        good = [i for i, x in enumerate(ids) if x is not None]
        flat = [np.array([t for i in good for t in ids[i][side]], np.int64) for side in (0, 1)]
        size = [np.array([len(table[t]) for t in f.tolist()], np.int64) for table, f in zip((self.pair.a_bytes, self.pair.b_bytes), flat, strict=True)]
        end = [np.cumsum(s) for s in size]  # the chunks one after another
        x, y = linked(*end)
        n = len(flat[0])
        root = components(n + len(flat[1]), x, y + n)
        chunk_end = np.cumsum([len(chunks[i]) for i in good]) if good else np.zeros(0, np.int64)
        owner = lambda e: np.searchsorted(chunk_end, e)
        per = lambda who: np.bincount(who, minlength=len(good))
        of_a, of_b, of_link = owner(end[0]), owner(end[1]), owner(np.union1d(*end))
        first = np.flatnonzero(root[:n] == np.arange(n))  # every component has an A token, its least node
        numbers[good] = np.stack((per(of_a), per(of_b), per(of_a[first]), per(of_link)), 1)
        a_cut = np.append(first, n)
        b_cut = np.append(np.searchsorted(root[n:], first), len(flat[1]))  # roots ascend with the position
        a_text, b_text = [str(t) for t in flat[0].tolist()], [str(t) for t in flat[1].tolist()]
        lines = [[] for _ in good]
        for g, who in enumerate(of_a[first].tolist()):
            lines[who].append(",".join(a_text[a_cut[g] : a_cut[g + 1]]) + "|" + ",".join(b_text[b_cut[g] : b_cut[g + 1]]) + ";")
        for i, line in zip(good, lines, strict=True):
            texts[i] = "".join(line).encode()
        return numbers, (flat[0][x] << 32) | flat[1][y], texts

    def look_up(self, keys: np.ndarray, chunk_of) -> np.ndarray:
        """Where each key's chunk is kept; new ones are aligned. chunk_of(i): the bytes of the i-th."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if self.bytes_held() > KEPT_BYTES:
                self.reset()
                new[:] = True
            self.learn(keys[new], [chunk_of(i) for i in np.flatnonzero(new).tolist()])
            at = np.searchsorted(self.keys, keys)
        return at


def chunk_starts(buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where chunks start: at documents' first bytes (a space each), and at single spaces between characters that surely are no white space."""
    at = np.flatnonzero(buf == 0x20)
    at = at[(at > 2) & (at + 1 < len(buf))]
    before, after = buf[at - 1], buf[at + 1]
    fine_before = _INK[before] | ((before >= 0x80) & ~_ODD[buf[at - 2]] & ~_ODD[buf[at - 3]])
    fine_after = _INK[after] | ((after >= 0x80) & ~_ODD[after])
    inner = at[fine_before & fine_after]
    starts = np.zeros(len(buf) + 1, bool)
    starts[inner] = True
    starts[np.minimum(begins + 1, len(buf))] = False  # the character after a document's own space
    nxt = begins[1:] - 1
    starts[nxt[nxt >= 0]] = False  # a space that ends a document
    starts[begins] = True
    return np.flatnonzero(starts[:-1])


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start[0], ..., start[0] + size[0] - 1, start[1], ..."""
    total = np.cumsum(size, dtype=np.int64)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - size - start, size)


def align_slice(aligner: Aligner, at: np.ndarray, data: np.ndarray, lens: np.ndarray) -> dict:
    """The aligned texts of a slice: numbers and digests of documents, distinct pairs with counts, and what each chunk has of them."""
    n = len(lens)
    full = np.flatnonzero(lens > 0)
    buf = np.full(int(lens.sum()) + len(full), 0x20, np.uint8)
    begin = np.cumsum(lens[full] + 1) - lens[full] - 1
    buf[spans(begin + 1, lens[full])] = data[spans(at[full], lens[full])]
    start = chunk_starts(buf, begin) if aligner.pair.cut_at_spaces else begin
    end = np.append(start[1:], len(buf))
    key = WORDS.spans(WORDS.prefix(WORDS.bytes[buf]), start, end) + (end - start).astype(np.uint64)
    keys, first, which = np.unique(key, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    kept = aligner.look_up(keys, lambda i: raw[start[first[i]] : end[first[i]]])
    numbers = aligner.numbers[kept].astype(np.int64)
    chunk_from = np.searchsorted(start, begin)
    chunk_count = np.diff(np.append(chunk_from, len(start)))
    add = lambda v: np.add.reduceat(v, chunk_from) if len(chunk_from) else v[:0]
    bad = add((numbers[:, 0] < 0)[which].astype(np.int64)) > 0
    good = np.repeat(~bad, chunk_count)
    which, chunk_count = which[good], chunk_count[~bad]
    doc = full[~bad]
    out = np.zeros((n, 4), np.int64)
    numbers = np.maximum(numbers, 0)
    edges = np.cumsum(chunk_count) - chunk_count
    digests = [""] * n
    if len(doc):
        out[doc] = np.add.reduceat(numbers[which], edges, axis=0)
        size = aligner.text_size[kept][which].astype(np.int64)
        text = aligner.texts[spans(aligner.text_at[kept][which], size)].tobytes()
        upto = np.cumsum(np.add.reduceat(size, edges)).tolist()
        for d, lo, hi in zip(doc.tolist(), [0, *upto], upto, strict=False):
            digests[d] = hashlib.sha256(text[lo : hi - 1]).hexdigest()
    used, which = np.unique(which, return_inverse=True)
    n_links = numbers[used, 3]
    links = aligner.links[spans(aligner.link_at[kept[used]], n_links)]
    pairs, link = np.unique(links, return_inverse=True)
    times = np.repeat(np.bincount(which, minlength=len(used)), n_links)
    counts = np.bincount(link, weights=times, minlength=len(pairs)).astype(np.int64)
    chunks = np.zeros(n, np.int32)
    chunks[doc] = chunk_count
    return {"numbers": out, "digests": digests, "pairs": pairs, "counts": counts, "link": link.astype(np.int32), "n_links": n_links.astype(np.int32), "which": which.astype(np.int32), "chunks": chunks}


PACKED = ("numbers", "link", "n_links", "which", "chunks")
SLICES = "sid long, ids array<long>, digests array<string>, pairs array<long>, counts array<long>, " + ", ".join(f"{c} binary" for c in PACKED)


def _align(a_path: str, b_path: str):
    def run(batches):
        aligner, part, n, zip_ = Aligner(Pair(a_path, b_path)), TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at, data, null = text_column(batch.column(1))
            lens = np.where(null, 0, np.diff(at))
            ids = batch.column(0)
            for i, j in cuts(lens, SLICE_BYTES):
                made = align_slice(aligner, at[i : j + 1], data, lens[i:j])
                n += 1
                row = {"sid": pa.array([(part << 20) + n - 1], pa.int64()), "ids": pa.array([ids[i:j].to_pylist()], pa.list_(pa.int64())), "digests": pa.array([made["digests"]], pa.list_(pa.string()))}
                row |= {c: pa.array([made[c]], pa.list_(pa.int64())) for c in ("pairs", "counts")}
                yield pa.RecordBatch.from_pydict(row | {c: pa.array([zip_.compress(made[c].tobytes())], pa.binary()) for c in PACKED})

    return run


def aligned_slices(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Slices of ``docs`` (doc_id, text), aligned and written once."""
    paths = a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE)
    return settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_align(*paths), SLICES))


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, count, best of all linked id pairs of aligned slices; a pair is A id * 2^32 + B id, best tells whether no partner of the B id has more."""
    spread = made.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("c"))
    total = spread.groupBy("pair").agg(F.sum("c").alias("count"))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    top = F.max("count").over(Window.partitionBy(b))  # at most A's vocabulary
    return settle(total.withColumn("best", F.col("count") == top))


def _report(batches):
    unzip = zstandard.ZstdDecompressor()
    for row in rows(batches):
        get = lambda c, kind: np.frombuffer(unzip.decompress(row[c]), kind)  # noqa: B023, E731
        numbers, chunks, which, link, n_links = get("numbers", np.int64).reshape(-1, 4), get("chunks", np.int32), get("which", np.int32), get("link", np.int32), get("n_links", np.int32)
        value = np.zeros((row["size"], 2), np.int64)
        for x in row["given"] or ():
            value[x["i"]] = x["count"], x["best"]
        upto = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(value[link], axis=0)))
        edge = np.cumsum(n_links, dtype=np.int64)
        of_chunk = upto[edge] - upto[edge - n_links]
        upto = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(of_chunk[which], axis=0)))
        edge = np.cumsum(chunks, dtype=np.int64)
        of_doc = upto[edge] - upto[edge - chunks]
        columns = [pa.array(row["ids"], pa.int64()), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(of_doc[:, 1]), pa.array(of_doc[:, 0]), pa.array(row["digests"], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``."""
    made = aligned_slices(docs, a_path, b_path)
    counts = pair_counts(made)
    spread = made.select("sid", F.posexplode("pairs").alias("i", "pair"))
    given = spread.join(bounded(counts, BROADCAST_ROWS), "pair").groupBy("sid").agg(F.collect_list(F.struct("i", "count", F.col("best").cast("int").alias("best"))).alias("given"))
    ready = made.select("sid", "ids", "digests", F.size("pairs").alias("size"), *PACKED).join(given, "sid", "left").drop("sid")
    return ready.mapInArrow(_report, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def token_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id and groups, an array of (a, b): the ids of both tokenizers in each minimal group, in order; null where a text has no tokens."""
    paths = a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE)

    def run(batches):
        aligner = Aligner(Pair(*paths))
        side = lambda s: [int(x) for x in s.split(",")]
        for batch in batches:
            groups = []
            for text in batch.column(1).to_pylist():
                lines = aligner.align([b" " + text.encode()])[2][0].decode() if text else ""
                groups.append([dict(zip(("a", "b"), map(side, g.split("|")), strict=True)) for g in lines.split(";")[:-1]] or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))], ["doc_id", "groups"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment(read(spark, sf_dir, "documents"))
