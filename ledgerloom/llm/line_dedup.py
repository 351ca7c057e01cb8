"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence a connected group.

Lines are normalised to words (A-Z lower-cased, each digit as 0, all other ASCII as a blank) and equal ones are one node, so
a very common line is a single node with its first place: slices send the hashes of their distinct lines to buckets, which
answer which of them come first. Two lines are near when their edit similarity over words,
1 - distance / longer length, is at least ``THRESHOLD``: a line of n words differs from a shorter one by at most k = floor((1 - t) n) edits.

At 0.8 fingerprints of related lines differ by about 13 of 64 bits, up to 21; so wide a radius leaves no block of the
fingerprint that selects anything. The pigeonhole blocks are therefore cut from the line, and none loses a pair:

* k = 1: the line's word sequences with one word left out; one edit leaves one of them, or the shorter line itself, in both.
* k > 1: q consecutive words (q = 2, from ``LONG`` words 3; numbered where they repeat). k edits spoil at most q k of them, so both lines hold
  n - q + 1 - q k others, and with blocks ordered by how many lines have them, one of those is among the rarest of each.

How many distinct lines have a block comes from an exchange of packed fingerprints by hash bucket, which answers a byte a block. A block of
one line needs no posting; most lines without a partner have so many that they post nothing. Round two asks the buckets in the same packed way which lists are still open. Postings carry the line's
64-bit SimHash over words and a histogram of its words (256 counts; with fewer, lines of many words that are no longer near pass too often). A pair is a candidate where fingerprints are
within ``radius`` (all are, unless a caller gives less than 64: near lines that repeat one word often may differ in half of the bits) and lengths and
histograms allow k edits (which never excludes a near pair). Candidates are verified by exact edit distance.

Round one pairs the lines of lists with a few leaders, a linear number of pairs, in the lists of at most ``FEW`` of each line's posted blocks. Round two lists all candidate pairs that are
still in different components, once for each run of posted blocks that they share, so that no link between components is lost while pairs inside one are never listed. Lists of more than ``CHUNK``
lines are cut into chunks, and each pair of chunks is a unit of work by itself.
Each group keeps its first occurrence (smallest doc_id, then place); every other occurrence goes.

Defined cases: null text has no lines and stays null; lines without a word are never removed; lines end at newline
bytes only; rows with a null doc_id sort last; repeated rows are documents of their own, in order of the slices; an
empty table gives an empty result; other columns are ignored. Nodes are known by 64-bit hashes of their word sequences,
words in the edit distance by 32-bit ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packed import ANSWER_SCHEMA, FIRST, NULL_ID, WORDS, Slice, answer, bucket_of, by_slice, column_parts, frequency, messages, mix, pack, replies, rows
from .runtime import bucket_count, read, settle, shuffle_partitions

THRESHOLD = 0.8
LONG = 20
LEADERS = 3
FEW = 6  # posted blocks of a line by which it looks for leaders
BINS = 256  # of a histogram of words
CHUNK = 4096
BUCKET_ROWS = 1 << 17
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[48:58] = 48
_FOLD[10] = 10
LONG_WORD = 64  # bytes; longer words are hashed by prefix sums over the slice
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of k bytes
_ODD, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ENTRY = "node long, doc_id long, sid long, line int, n int, print long, bag binary, posts array<struct<tok:long,prev:long,code:int,few:boolean>>, words binary"


class Texts:
    """The bytes of a slice by document and line, without its words."""

    def __init__(self, row: dict):
        self.ids, self.lens = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lens"], "<i4")
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
        self.byte = np.concatenate(([0], np.cumsum(np.maximum(self.lens, 0) + 1)))
        self.newline = np.flatnonzero(self.raw == 10)
        self.first = np.searchsorted(self.newline, self.byte)


class Lines:
    """Lines of a slice: line i ends at newline[i]; document d has lines first[d] to first[d + 1] (none if null)."""

    def __init__(self, row: dict):
        self.s = Slice.of(row, _FOLD)
        self.newline = np.flatnonzero(self.s.raw == 10)
        self.first = np.searchsorted(self.newline, self.s.byte)
        at = np.searchsorted(self.s.start, np.concatenate(([-1], self.newline)))
        self.begin, self.stop = at[:-1], at[1:]

    def hashed(self) -> "Lines":
        self.hash = word_hash(self.s)
        self.prefix = FIRST.prefix(self.hash)
        return self

    def numbers(self) -> np.ndarray:
        """Lines with a word."""
        return np.flatnonzero(self.stop > self.begin)

    def keys(self, lines: np.ndarray) -> np.ndarray:
        b, e = self.begin[lines], self.stop[lines]
        return mix(FIRST.spans(self.prefix, b, e) + (e - b).astype(np.uint64))

    def prints(self, lines: np.ndarray) -> np.ndarray:
        """SimHash over the words of each line."""
        if not len(lines):
            return np.zeros(0, np.uint64)
        n = (self.stop - self.begin)[lines]
        row, at = _ragged(n)
        bits = np.unpackbits(mix(self.hash[self.begin[lines[row]] + at]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        return np.packbits(2 * votes > n[:, None], axis=1).view("<u8")[:, 0]

    def histograms(self, lines: np.ndarray) -> list[bytes]:
        """Of each line ``BINS`` counts of its words by hash, two a byte, 15 for more."""
        row, at = _ragged((self.stop - self.begin)[lines])
        bin_ = (mix(self.hash[self.begin[lines[row]] + at]) >> np.uint64(65 - BINS.bit_length())).astype(np.int64)
        out = []
        for low in range(0, len(lines), 1 << 12):
            i, j = np.searchsorted(row, (low, low + (1 << 12)))
            size = min(len(lines) - low, 1 << 12)
            count = np.minimum(np.bincount((row[i:j] - low) * BINS + bin_[i:j], minlength=BINS * size), 15).astype(np.uint8).reshape(size, BINS // 2, 2)
            out += [x.tobytes() for x in count[:, :, 0] | count[:, :, 1] << 4]
        return out


def word_hash(s: Slice) -> np.ndarray:
    """64-bit hashes of the words of a slice, eight bytes at a time."""
    n = s.end - s.start
    whole = np.zeros(len(s.buf) // 8 + 2, np.uint64)
    whole.view(np.uint8)[: len(s.buf)] = s.buf
    one, bits = np.uint64(1), np.uint64(63)

    def eight(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Up to eight bytes from ``at``."""
        i, off = at >> 3, (at.astype(np.uint64) << np.uint64(3)) & bits
        return (whole[i] >> off | (whole[i + 1] << one) << (bits - off)) & _BELOW[np.minimum(size, 8)]

    h = mix(eight(s.start, n) + n.astype(np.uint64) * _LENGTH)
    long = n > LONG_WORD
    at = np.flatnonzero((n > 8) & ~long)
    for done in range(8, LONG_WORD, 8):
        at = at[n[at] > done]
        if not len(at):
            break
        h[at] = mix(h[at] * _ODD + eight(s.start[at] + done, n[at] - done))
    if long.any():
        h[long] = WORDS.spans(WORDS.prefix(WORDS.bytes[s.buf]), s.start[long], s.end[long])
    return h


def _ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 0 .. count - 1) of each row, row by row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def edits(n: np.ndarray, threshold: float) -> np.ndarray:
    """Edits allowed between a line of n words and one that is not longer."""
    return np.floor((1 - threshold) * n + 1e-9).astype(np.int64)


def _plan(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """For lines of ``n`` words: (whether words are left out, whether the whole line is sent, for each q how many of the rarest blocks are posted).

    A line must post enough for every partner that is not shorter, in the blocks of that partner's length.
    """
    top = int(n.max(initial=0) / threshold) + 2
    every = np.arange(top + 1)
    k = edits(every, threshold)
    out = k == 1
    q_of = np.where(k > 1, np.where(every < LONG, 2, 3), 0)
    for q in (3, 2):  # fewer words a block where edits could spoil all of them
        q_of = np.where((q_of == q) & (every - q + 1 - q * k < 1), q - 1, q_of)
    lengths, which = np.unique(n, return_inverse=True)
    partners = np.stack((lengths, np.searchsorted(every - k, lengths, "right")), axis=1).ravel()  # lengths from .. below ..
    post = {}
    for q in (1, 2, 3):
        shared = np.where(q_of == q, every - q + 1 - q * k, top)  # by the longer line
        least = np.minimum.reduceat(np.append(shared, top), partners)[::2] if len(partners) else partners
        post[q] = np.where(least < top, lengths - q + 2 - least, 0)[which]
    return out[n], (out | np.append(out[1:], False))[n], post


class Blocks:
    """Pigeonhole blocks of lines, by line: hash, index in ``lines``, and how many of the line's rarest of that kind to post."""

    def __init__(self, x: Lines, lines: np.ndarray, threshold: float):
        self.begin, self.stop = x.begin[lines], x.stop[lines]
        self.n = self.stop - self.begin
        out, whole, post = _plan(self.n, threshold)
        parts = []
        for q, rarest in post.items():
            mine = np.flatnonzero((rarest > 0) & (self.n >= q))
            if len(mine):
                r, at = _ragged(self.n[mine] - q + 1)
                first = self.begin[mine[r]] + at
                parts.append((*_distinct(FIRST.spans(x.prefix, first, first + q), mine[r], q, True), rarest))
        mine, full = np.flatnonzero(out), np.flatnonzero(whole)
        if len(full):
            r, at = _ragged(self.n[mine])
            r = mine[r]
            b, e, i = self.begin[r], self.stop[r], self.begin[r] + at
            shift = np.uint64(pow(FIRST.base, -1, 1 << 64))
            left_out = mix(((x.prefix[i] - x.prefix[b]) + (x.prefix[e] - x.prefix[i + 1]) * shift) * FIRST.powers(len(x.prefix), FIRST.inverse)[b])
            entire = FIRST.spans(x.prefix, self.begin[full], self.stop[full])
            parts.append((*_distinct(np.concatenate((left_out, entire)), np.concatenate((r, full)), 9, False), np.full(len(lines), 1 << 30)))
        self.parts = [(row, rarest) for _, row, rarest in parts]
        self.value = np.concatenate([value for value, _, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.row = np.concatenate([row for row, _ in self.parts]) if parts else np.zeros(0, np.int64)

    def posted(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the blocks to post, given the codes of their frequencies (0: of one line only, which need no posting), and the hash of the
        block that the same line posts before each of them (0: none)."""
        chosen, before, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        for row, rarest in self.parts:
            mine, value = code[begin : begin + len(row)], self.value[begin : begin + len(row)]
            more = rarest - np.bincount(row[mine == 0], minlength=len(rarest))
            at = np.flatnonzero((mine > 0) & (more[row] > 0))
            at = at[np.lexsort(((mine[at].astype(np.uint64) << np.uint64(56)) | (value[at] >> np.uint64(8)), row[at]))]
            r = row[at]
            new = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
            rank = np.arange(len(r)) - np.repeat(new, np.diff(np.append(new, len(r))))
            at = at[rank < more[r]]
            last = np.zeros(len(at), np.uint64)
            last[1:] = np.where(row[at[1:]] == row[at[:-1]], value[at[:-1]], np.uint64(0))
            chosen.append(begin + at)
            before.append(last)
            begin += len(row)
        return np.concatenate(chosen), np.concatenate(before)


_BITS = 48  # of a block's hash


def _distinct(h: np.ndarray, row: np.ndarray, kind: int, numbered: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct blocks of each row, by row; if ``numbered``, repeats are blocks of their own."""
    values, rows_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    order = None if len(row) == 0 or (row[1:] >= row[:-1]).all() else np.argsort(row, kind="stable")
    if order is not None:
        h, row = h[order], row[order]
    bits = np.uint64(_BITS)
    step = 1 << (64 - _BITS)
    for low in range(0, int(row[-1]) + 1 if len(row) else 0, step):  # row and hash in one number
        i, j = np.searchsorted(row, (low, low + step))
        key = np.sort((row[i:j] - low).astype(np.uint64) << bits | h[i:j] >> np.uint64(64 - _BITS))
        if not len(key):
            continue
        new = np.concatenate(([True], key[1:] != key[:-1]))
        value = (key & np.uint64((1 << _BITS) - 1)) + (np.uint64(kind) << bits)
        if numbered:
            first = np.flatnonzero(new)
            value = mix(value)
            if len(first) < len(key):
                nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
                value = np.where(nth > 0, mix(value + nth.astype(np.uint64)), value)
        else:
            key, value = key[new], mix(value[new])
        values.append(value)
        rows_.append((key >> bits).astype(np.int64) + low)
    return np.concatenate(values), np.concatenate(rows_)


def _occurrences(buckets: int, least: int):
    """The first occurrence in the slice of each distinct line, to the line's bucket; ``~line`` where it has fewer than ``least`` words. Others of the slice are ``spare``."""

    def run(batches):
        for row in rows(batches):
            x = Lines(row).hashed()
            at = x.numbers()
            if not len(at):
                continue
            key, doc = x.keys(at), x.s.ids[np.searchsorted(x.first, at, "right") - 1]
            order = np.lexsort((doc, key))  # stable: by line within a document
            new = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
            first, spare = order[new], at[order[~new]].astype(np.int32)
            line = np.where((x.stop - x.begin)[at[first]] < least, ~at[first], at[first]).astype(np.int32)
            sent = messages(row["sid"], bucket_of(key[first], buckets), buckets, key=key[first], doc=doc[first], line=line)
            yield sent.append_column("spare", pa.array([spare.tobytes()] + [b""] * (sent.num_rows - 1), pa.binary()))

    return run


_SAME = "sid long, want array<int>, later array<int>"


def _firsts(table: pa.Table) -> pa.Table:
    """By slice: the lines of enough words that come before all equal ones (smallest doc_id, then place), and the lines that don't."""
    sid, lines, spare = np.asarray(table.column("sid")), column_parts(table, "line", np.int32), column_parts(table, "spare", np.int32)
    message = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    line = np.concatenate(lines)
    key, doc = np.concatenate(column_parts(table, "key", np.uint64)), np.concatenate(column_parts(table, "doc", np.int64))
    order = np.lexsort((sid[message], doc, key))
    first = np.zeros(len(key), bool)
    first[order[np.concatenate(([True], key[order[1:]] != key[order[:-1]]))]] = True

    def lists(value: np.ndarray, of: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(lines))))), pa.int32()), pa.array(value, pa.int32()))

    of = np.repeat(np.arange(len(lines)), [len(x) for x in spare])
    later, of = np.concatenate((np.where(line < 0, ~line, line)[~first], *spare)), np.concatenate((message[~first], of))
    want = first & (line >= 0)
    return pa.table({"sid": table.column("sid"), "want": lists(line[want], message[want]), "later": lists(later[np.argsort(of, kind="stable")], of)})


def _ask(buckets: int, threshold: float):
    def run(batches):
        for row in rows(batches, ("want",)):
            h = Blocks(Lines(row).hashed(), np.sort(row["want"]), threshold).value
            if len(h):
                yield messages(row["sid"], bucket_of(h, buckets), buckets, prints=h.astype(np.uint32))

    return run


def _post(buckets: int, threshold: float):
    """A row for each line that has postings: them, the line's words and what the filters need. ``FEW`` of its postings, the same for equal ones, are marked."""

    def run(batches):
        for row in rows(batches, ("want",)):
            x, lines = Lines(row).hashed(), np.sort(row["want"])
            b = Blocks(x, lines, threshold)
            code = replies(bucket_of(b.value, buckets), buckets, row["df"], np.uint8)
            at, prev = b.posted(code)
            used, which = np.unique(b.row[at], return_inverse=True)
            if not len(used):
                continue
            mine = lines[used]
            order = np.argsort(which, kind="stable")
            at, prev, which = at[order], prev[order], which[order]
            count = np.bincount(which)
            first = np.cumsum(count) - count
            few = np.zeros(len(at), bool)
            few[np.lexsort((b.value[at], which))] = np.arange(len(at)) - np.repeat(first, count) < FEW
            parts = [pa.array(b.value[at].view(np.int64)), pa.array(prev.view(np.int64)), pa.array(code[at], pa.int32()), pa.array(few)]
            small = (x.hash >> np.uint64(32)).astype("<u4")
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(x.keys(mine).view(np.int64)), "doc_id": pa.array(x.s.ids[np.searchsorted(x.first, mine, "right") - 1], pa.int64()), "sid": pa.array(np.full(len(mine), row["sid"]), pa.int64()), "line": pa.array(mine, pa.int32()),
                "n": pa.array(b.n[used], pa.int32()), "print": pa.array(x.prints(mine).view(np.int64)), "bag": pa.array(x.histograms(mine), pa.binary()),
                "posts": pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.StructArray.from_arrays(parts, ["tok", "prev", "code", "few"])),
                "words": pa.array([small[i:j].tobytes() for i, j in zip(x.begin[mine], x.stop[mine], strict=True)], pa.binary()),
            })

    return run


class Postings:
    """Postings of some lists; a list is a run of equal (block, cell). In a cell of two chunks only pairs across them count."""

    def __init__(self, table: pa.Table, threshold: float, radius: int, split: bool):
        got = {c: np.asarray(table.column(c).combine_chunks()) for c in table.column_names if c not in ("bucket", "bag")}
        got = {c: v.view(np.uint64) if c == "print" else v for c, v in got.items()}
        got.setdefault("prev", np.zeros(table.num_rows, np.int64))  # unknown: each list gives its pairs
        order = np.lexsort((got["node"], got["cell"], got["tok"]))
        got = {c: v[order] for c, v in got.items()}
        new = np.concatenate(([True], (got["tok"][1:] != got["tok"][:-1]) | (got["cell"][1:] != got["cell"][:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        part = got["component"] if split else got["node"]
        live = np.repeat(np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first), size)
        self.list = (np.cumsum(new) - 1)[live]
        self.node, self.prev, self.component, self.n, self.print, self.chunk, self.across = (v[live] for v in (got["node"], got["prev"], part, got["n"], got["print"], got["chunk"], got["across"]))
        # a line's histogram (``bag``, else the 32 counts of ``low`` and ``high``) is kept once, however many lists it is in
        _, at, self.bag = np.unique(self.node, return_index=True, return_inverse=True)
        if "bag" in table.column_names:
            self.count = np.frombuffer(b"".join(table.column("bag").take(pa.array(order[live][at])).to_pylist()), np.uint8).reshape(len(at), BINS // 2)
        else:
            self.count = np.stack((got["low"][live][at], got["high"][live][at]), axis=1).astype("<i8").view(np.uint8).reshape(len(at), 16)
        self.edits, self.radius = edits(self.n, threshold), radius

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are candidates."""
        gap = np.abs(self.n[i] - self.n[j])
        most = np.maximum(self.edits[i], self.edits[j])
        ok = (self.component[i] != self.component[j]) & (gap <= most) & (np.bitwise_count(self.print[i] ^ self.print[j]) <= self.radius) & (~self.across[i] | (self.chunk[i] != self.chunk[j]))
        at = np.flatnonzero(ok)
        for a in range(0, len(at), 1 << 13):
            p = at[a : a + (1 << 13)]
            x, y = self.count[self.bag[i[p]]], self.count[self.bag[j[p]]]
            apart = sum(np.abs((f(x) - f(y)).view(np.int8)).sum(axis=1, dtype=np.int16) for f in (lambda c: c & 15, lambda c: c >> 4))
            ok[p] = apart.astype(np.int64) <= 2 * most[p] - gap[p]
        return ok

    def led(self):
        """Pairs (leader, member): in each list the first line not yet led leads all candidates among the others, ``LEADERS`` times."""
        here = np.arange(len(self.list))
        for _ in range(LEADERS):
            if not len(here):
                return
            begin = np.flatnonzero(np.concatenate(([True], self.list[here][1:] != self.list[here][:-1])))
            lead = np.repeat(here[begin], np.diff(np.append(begin, len(here))))
            member = (here != lead) & self.near(here, lead)
            yield lead[member], here[member]
            here = here[~member & (here != lead)]

    def all(self):
        """All candidate pairs. Two lines that have the same block before this one meet in that block's list, too, and need not meet here."""
        here = np.arange(len(self.list))
        for d in range(1, len(self.list)):
            here = here[: np.searchsorted(here, len(self.list) - d)]
            here = here[self.list[here + d] == self.list[here]]
            if not len(here):
                return
            for a in range(0, len(here), 1 << 20):
                i = here[a : a + (1 << 20)]
                i = i[(self.prev[i] != self.prev[i + d]) | (self.prev[i] == 0)]
                i = i[self.near(i, i + d)]
                yield i, i + d


def _compare(threshold: float, radius: int, split: bool):
    def run(table: pa.Table) -> pa.Table:
        p, seen = Postings(table, threshold, radius, split), [np.zeros((2, 0), np.int64)]
        for i, j in p.all() if split else p.led():
            seen.append(np.stack((np.minimum(p.node[i], p.node[j]), np.maximum(p.node[i], p.node[j]))))
        u, v = np.concatenate(seen, axis=1)
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))) if len(u) else np.zeros(0, bool)
        return pa.table({"u": pa.array(u[new], pa.int64()), "v": pa.array(v[new], pa.int64())})

    return run


def _pairs(postings: DataFrame, buckets: int, threshold: float, radius: int, split: bool) -> DataFrame:
    """Distinct candidates (u, v). Long lists are cut into chunks: by leaders each chunk stands alone, else each pair of chunks is a cell."""
    lines = F.pow(F.lit(2.0), (F.col("code") + 1) / 6.0)  # at most so many have the block
    chunks = F.when(F.col("code") < 255, F.ceil(lines / CHUNK)).otherwise(F.lit(1 << 12))
    dealt = postings.withColumn("chunk", F.pmod(F.xxhash64("node", "tok"), chunks))
    if split:
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)))
        dealt = dealt.withColumn("cell", F.least("chunk", "other") * (1 << 20) + F.greatest("chunk", "other")).withColumn("across", F.col("chunk") != F.col("other")).drop("other")
    else:
        dealt = dealt.withColumn("cell", F.col("chunk")).withColumn("across", F.lit(False))
    dealt = dealt.drop("code").withColumn("bucket", F.pmod(F.xxhash64("tok", "cell"), F.lit(buckets)))
    # a bucket travels as one group of whole lists
    return settle(dealt.groupBy("bucket").applyInArrow(_compare(threshold, radius, split), "u long, v long").distinct(), large=True)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int | None = None) -> int:
    """Levenshtein distance of two sequences, by bit-parallel columns. Beyond ``most`` it may be any number that is, too."""
    if len(a) < len(b):
        a, b = b, a
    for _ in range(2):  # equal words at the end, then at the beginning
        a, b = a[::-1], b[::-1]
        apart = np.flatnonzero(a[: len(b)] != b)
        same = apart[0] if len(apart) else len(b)
        a, b = a[same:], b[same:]
    m = len(b)
    if not m:
        return len(a)
    places: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    last = len(a) + (most if most is not None else len(a))  # each column lowers the score by one at most
    for i, w in enumerate(a.tolist()):
        if score > last - i:
            return score - len(a) + i
        eq = places.get(w, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(d | up) & full, up & d
        score += bool(more & top) - bool(less & top)
        more = (more << 1 | 1) & full
        up, down = (less << 1) & full | ~(d | more) & full, more & d
    return score


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds) of a column of sequences of 32-bit words."""
    column = column.cast(pa.large_binary())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    words = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return words.view("<u4"), (bounds - bounds[0]) // 4


def similar(a: pa.Array, b: pa.Array, threshold: float) -> np.ndarray:
    """Which pairs of sequences have the edit similarity.

    Sequences of one length that differ in few places do; those of which one has too many words that the other lacks don't. The distance is for the rest.
    """
    (x, p), (y, q) = _sequences(a), _sequences(b)
    n, m = np.diff(p), np.diff(q)
    most = edits(np.maximum(n, m), threshold)
    keep = np.zeros(len(n), bool)
    same = np.flatnonzero(n == m)
    row, at = _ragged(n[same])
    apart = np.bincount(row, x[p[same[row]] + at] != y[q[same[row]] + at], len(same))
    keep[same] = apart <= most[same]
    rest = np.flatnonzero(~keep & (np.abs(n - m) <= most))
    (i, u), (j, v) = _ragged(n[rest]), _ragged(m[rest])
    one, two, three = np.uint64(1), np.uint64(32), np.uint64(33)
    key = np.sort(np.concatenate(((i.astype(np.uint64) << two | x[p[rest[i]] + u]) << one, (j.astype(np.uint64) << three) | y[q[rest[j]] + v].astype(np.uint64) << one | one)))
    if not len(key):
        return keep
    first = np.flatnonzero(np.concatenate(([True], key[1:] >> one != key[:-1] >> one)))
    more = np.add.reduceat(1 - 2 * (key & one).astype(np.int64), first)  # of each word in the first than in the second
    of = (key[first] >> three).astype(np.int64)
    lack = np.maximum(np.bincount(of, np.maximum(more, 0), len(rest)), np.bincount(of, np.maximum(-more, 0), len(rest)))
    for k in rest[lack <= most[rest]].tolist():
        keep[k] = edit_distance(x[p[k] : p[k + 1]], y[q[k] : q[k + 1]], int(most[k])) <= most[k]
    return keep


def _similar(threshold: float):
    def run(batches):
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(similar(batch.column(2), batch.column(3), threshold), pa.bool_()))

    return run


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    left = words.select(F.col("node").alias("u"), F.col("words").alias("a"))
    right = words.select(F.col("node").alias("v"), F.col("words").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_similar(threshold), "u long, v long")


_HELD = "sid long, lines binary, count binary, posts binary"


def _hold(batches):
    """Lines of a batch and their postings in one row; a row's number is its own."""
    n, part, zip_ = 0, TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        posts, lines, out = batch.column("posts"), batch.drop_columns(["posts"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, lines.schema) as to:
            to.write_batch(lines)
        flat = posts.flatten()
        tok, prev, code = (np.asarray(flat.field(c)) for c in ("tok", "prev", "code"))
        held = {"lines": zip_.compress(out.getvalue()), "count": np.diff(np.asarray(posts.offsets)).astype(np.int32).tobytes()}
        held["posts"] = zip_.compress(tok.tobytes() + prev.tobytes() + code.astype(np.uint8).tobytes())  # most of prev repeats tok
        yield pa.RecordBatch.from_pydict({"sid": pa.array([(part << 32) + n], pa.int64())} | {c: pa.array([v], pa.binary()) for c, v in held.items()})
        n += 1


class Held:
    """Postings of a row of ``_hold``. Of each distinct list, ``entry`` has one (block, component, block before), or two where the lines here differ: the least and the greatest."""

    def __init__(self, row: dict):
        unzip = zstandard.ZstdDecompressor()
        self.lines = pa.ipc.open_stream(unzip.decompress(row["lines"])).read_next_batch()
        count = np.frombuffer(row["count"], np.int32)
        n = int(count.sum())
        whole = unzip.decompress(row["posts"])
        self.tok, self.prev, self.code = np.frombuffer(whole, np.int64, n), np.frombuffer(whole, np.int64, n, 8 * n), np.frombuffer(whole, np.uint8, n, 16 * n)
        self.line = np.repeat(np.arange(len(count)), count)
        order = np.argsort(self.tok, kind="stable")
        tok, component, prev = self.tok[order], np.asarray(self.lines.column("component"))[self.line[order]], self.prev[order]
        new = np.concatenate(([True], tok[1:] != tok[:-1]))[:n]
        first = np.flatnonzero(new)
        self.lists = len(first)
        self.which = np.empty(n, np.int64)
        self.which[order] = np.cumsum(new) - 1
        low, high = ([f.reduceat(v, first) if n else v for v in (component, prev)] for f in (np.minimum, np.maximum))
        apart = (low[0] != high[0]) | (low[1] != high[1])
        self.entry = [np.concatenate((v, w[apart])) for v, w in ((tok[first], tok[first]), *zip(low, high, strict=True))]
        self.hash = self.entry[0].view(np.uint64)


def _spread(buckets: int):
    def run(batches):
        for row in rows(batches):
            h = Held(row)
            if len(h.hash):
                yield messages(row["sid"], bucket_of(h.hash, buckets), buckets, tok=h.entry[0], component=h.entry[1], prev=h.entry[2])

    return run


def _open(table: pa.Table) -> pa.Table:
    """A bit an entry: whether its list has lines of several components that don't all post the same block before."""
    parts = column_parts(table, "tok", np.int64)
    tok, component, prev = (np.concatenate(column_parts(table, c, np.int64)) for c in ("tok", "component", "prev"))
    order = np.argsort(tok)
    tok, component, prev = tok[order], component[order], prev[order]
    first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
    least, most = np.minimum.reduceat(prev, first), np.maximum.reduceat(prev, first)
    found = (np.minimum.reduceat(component, first) != np.maximum.reduceat(component, first)) & ((least != most) | (least == 0))
    out = np.empty(len(tok), bool)
    out[order] = np.repeat(found, np.diff(np.append(first, len(tok))))
    return answer(table, np.split(out, np.cumsum([len(p) for p in parts])[:-1]))


def _opened(buckets: int):
    def run(batches):
        for row in rows(batches):
            h = Held(row)
            at = np.flatnonzero(replies(bucket_of(h.hash, buckets), buckets, row["open"], bool)[: h.lists][h.which])
            posts = {"tok": pa.array(h.tok[at], pa.int64()), "prev": pa.array(h.prev[at], pa.int64()), "code": pa.array(h.code[at], pa.int32())}
            lines = h.lines.take(pa.array(h.line[at]))
            yield pa.RecordBatch.from_pydict(dict(zip(lines.schema.names, lines.columns, strict=True)) | posts)

    return run


def _across(found: DataFrame, line: DataFrame, part: DataFrame | None, buckets: int | None = None) -> DataFrame:
    """Postings, with the columns of ``line`` and their lines' ``component``, of the lists that hold more than one.

    Not of a list whose lines all post the same block before this one: all of its pairs meet in that block's list, too.
    Batches of lines ask about their lists in packed buckets; a list is in a batch's message twice at most, however many lines have it.
    """
    buckets = buckets or 2 * shuffle_partitions(found.sparkSession)
    lines = found.select(*line.columns, "posts")
    lines = lines.withColumn("component", F.col("node")) if part is None else lines.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = settle(lines.mapInArrow(_hold, _HELD), large=True)
    sent = held.mapInArrow(_spread(buckets), "sid long, bucket int, tok binary, component binary, prev binary")
    open_ = settle(by_slice(sent.groupBy("bucket").applyInArrow(_open, ANSWER_SCHEMA), "open"), large=True)
    columns = ", ".join(f"{c} {kind}" for c, kind in lines.drop("posts").dtypes)
    return held.join(open_, "sid").mapInArrow(_opened(buckets), columns + ", tok long, prev long, code int")


def _groups(same: DataFrame, slices: DataFrame, buckets: int, threshold: float, radius: int) -> DataFrame | None:
    """(sid, linked): lines that are the first of their kind but near another that comes before, or linked with one; None if none is."""
    asked = slices.join(same.where(F.size("want") > 0).select("sid", "want"), "sid")
    sent = asked.mapInArrow(_ask(buckets, threshold), "sid long, bucket int, prints binary")
    df = settle(by_slice(sent.groupBy("bucket").applyInArrow(frequency, ANSWER_SCHEMA), "df"), large=True)
    found = settle(asked.join(df, "sid").mapInArrow(_post(buckets, threshold), _ENTRY), large=True)
    del asked, sent, df  # their checkpoints go
    words, line = found.select("node", "words"), found.select("node", "n", "print", "bag")
    size, few = found.select(F.coalesce(F.sum(F.size("posts")), F.lit(0)), F.coalesce(F.sum(F.least(F.size("posts"), F.lit(FEW))), F.lit(0))).first()
    part = None
    for split in (False, True):
        if split:
            live = _across(found, line, part, buckets)
        else:
            live = found.select("node", "n", "print", "bag", F.inline("posts")).where("few").drop("few")
        lists = max(2 * shuffle_partitions(slices.sparkSession), -(-(size if split else few) // BUCKET_ROWS))
        pairs = _pairs(live, lists, threshold, radius, split)
        if pairs.isEmpty():
            continue  # no leader's pair, but others may be there
        links = settle(_verified(pairs, words, threshold), large=True)
        old = [] if part is None else [part.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))]
        for o in old:
            links = links.unionByName(o)
        part = settle(components(links))
    if part is None:
        return None
    linked = settle(part.join(found.select("node", F.struct("doc_id", "sid", "line").alias("at")), "node").select("component", "at"), large=True)
    group = linked.groupBy("component").agg(F.min("at").alias("least"))
    return linked.join(group, "component").where("at <> least").groupBy("at.sid").agg(F.collect_list("at.line").alias("linked"))


def _cut(batches):
    for row in rows(batches):
        x = Texts(row)
        drop = np.zeros(len(x.newline), bool)
        drop[row["gone"] or []] = True
        count = np.where(x.lens < 0, 0, np.diff(x.first))
        lost = np.concatenate(([0], np.cumsum(drop)))[x.first]
        raw = x.raw
        begin = np.concatenate(([0], x.newline[:-1] + 1))
        keep = np.repeat(~drop, x.newline + 1 - begin)
        kept = raw[keep]
        upto = np.concatenate(([0], np.cumsum(keep)))[x.byte]
        texts = [None if n < 0 else kept[i : max(i, j - 1)].tobytes() for i, j, n in zip(upto[:-1], upto[1:], x.lens, strict=True)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(x.ids, pa.int64(), mask=x.ids == NULL_ID), "n_lines": pa.array(count, pa.int64()),
            "n_removed": pa.array(np.diff(lost), pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
        })


def remove_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, radius: int = 64) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_lines, n_removed, kept_text (the lines left, joined by newlines)."""
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above a half")
    buckets = bucket_count(docs)
    slices = pack(docs, -(-buckets // 2))  # by sid, as three joins need them
    least = next(n for n in range(1, 1 << 20) if edits(n, threshold) > 0) - 1 if threshold < 1 else None
    sent = slices.mapInArrow(_occurrences(buckets, least or 0), "sid long, bucket int, key binary, doc binary, line binary, spare binary")
    same = sent.groupBy("bucket").applyInArrow(_firsts, _SAME).groupBy("sid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("want", "later")))
    same = settle(same, large=True)
    gone, linked = same.select("sid", "later"), None if least is None else _groups(same, slices, buckets, threshold, radius)
    if linked is None:
        gone = gone.withColumnRenamed("later", "gone")
    else:
        gone = gone.join(linked, "sid", "left").select("sid", F.concat("later", F.coalesce("linked", F.array().cast("array<int>"))).alias("gone"))
    return slices.join(settle(gone, large=True), "sid", "left").mapInArrow(_cut, "doc_id long, n_lines long, n_removed long, kept_text string")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
