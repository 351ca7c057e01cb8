"""Substring dedup with fixed-block anchors.

Non-overlapping blocks of ``block`` words (those that start at multiples of ``block`` in their document) are the
index; every rolling window of ``block`` words of every document probes it. Any passage of ``min_words`` >=
2 * block - 1 words holds a whole indexed block, so each repeat has an anchor hit on both sides. Hits are then
extended: each window of ``min_words`` words around a hit is compared by a 96-bit fingerprint of its whole word
sequence, the earliest occurrence stays, and the covered words of all later ones join into maximal exact repeats.

Both exchanges go through hash buckets whose number grows with the input. A bucket gets packed fingerprints (four
bytes a probe, twelve a candidate) and answers one bit each, in the order sent, so neither positions nor pairs are
shuffled and a passage with any number of copies costs its occurrences once: no pairs are made. A bucket holds all
occurrences of its fingerprints as flat arrays; a document of one repeated word puts its windows into one bucket at
twelve bytes each.

Defined cases: null text counts as empty (no words, empty kept text); words are runs of bytes other than
0x20 and 0x09-0x0D; rows with a null doc_id come last in the order of documents and keep their null; rows that
repeat a doc_id are documents of their own, in the order of the slices; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import (ANSWER_SCHEMA, FIRST, NULL_ID, SECOND, Slice, answer, bucket_of, by_slice, column_parts, messages, pack, replies, rows)
from .runtime import bucket_count, settle

RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,stop:long>>"


def _probe(s: Slice, block: int) -> tuple[np.ndarray, np.ndarray]:
    at = s.windows(block)
    return at, FIRST.spans(FIRST.prefix(s.word_hash()), at, at + block)


def _candidates(s: Slice, at: np.ndarray, hit: np.ndarray, block: int, words: int):
    """Starts of windows of ``words`` words that hold a hit, with two fingerprints."""
    h = s.word_hash()
    marks = np.zeros(len(h) + 1, np.int64)
    marks[at[hit] + 1] = 1
    upto = np.cumsum(marks)
    start = s.windows(words)
    start = start[upto[start + words - block + 1] > upto[start]]
    return start, FIRST.spans(FIRST.prefix(h), start, start + words), SECOND.spans(SECOND.prefix(h), start, start + words)


def _send_probes(buckets: int, block: int):
    def run(batches):
        for row in rows(batches):
            s = Slice.of(row)
            at, h = _probe(s, block)
            if len(at):
                yield messages(row["sid"], bucket_of(h, buckets), buckets, prints=h.astype(np.uint32), blocks=s.position()[at] % block == 0)

    return run


def _match_anchors(table: pa.Table) -> pa.Table:
    parts = column_parts(table, "prints", np.uint32)
    sizes = [len(p) for p in parts]
    prints = np.concatenate(parts)
    blocks = np.concatenate([np.unpackbits(b, count=n).astype(bool) for b, n in zip(column_parts(table, "blocks", np.uint8), sizes, strict=True)])
    ordered = np.sort(prints)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    anchors = np.intersect1d(again, np.unique(prints[blocks]), assume_unique=True)
    return answer(table, np.split(np.isin(prints, anchors), np.cumsum(sizes)[:-1]))


def _send_candidates(buckets: int, block: int, words: int):
    def run(batches):
        for row in rows(batches):
            s = Slice.of(row)
            at, h = _probe(s, block)
            start, one, two = _candidates(s, at, replies(bucket_of(h, buckets), buckets, row["anchors"], bool), block, words)
            if len(start):
                doc = np.searchsorted(s.first, start, "right") - 1
                bucket = bucket_of(one, buckets)
                out = messages(row["sid"], bucket, buckets, one=one, two=two.astype(np.uint32))
                order = np.argsort(bucket, kind="stable")
                sorted_bucket, sorted_doc = bucket[order], doc[order]
                new = np.flatnonzero(np.concatenate(([True], (np.diff(sorted_bucket) != 0) | (np.diff(sorted_doc) != 0))))
                size = np.diff(np.append(new, len(order))).astype("<u4")
                begin = np.flatnonzero(np.concatenate(([True], np.diff(sorted_bucket[new]) != 0)))
                ids = [x.tobytes() for x in np.split(s.ids[sorted_doc[new]].astype("<i8"), begin[1:])]
                runs = [x.tobytes() for x in np.split(size, begin[1:])]
                yield out.append_column("docs", pa.array(ids, pa.binary())).append_column("runs", pa.array(runs, pa.binary()))

    return run


def _later(table: pa.Table) -> pa.Table:
    """True for each candidate of which an equal one starts earlier."""
    ones, twos = column_parts(table, "one", np.uint64), column_parts(table, "two", np.uint32)
    docs, runs = column_parts(table, "docs", "<i8"), column_parts(table, "runs", "<u4")
    sid = np.asarray(table.column("sid").combine_chunks())
    run_sid, run_doc, run_size = np.repeat(sid, [len(x) for x in runs]), np.concatenate(docs), np.concatenate(runs).astype(np.int64)
    place = np.lexsort((np.arange(len(run_doc)), run_sid, run_doc))
    begin = np.concatenate(([0], np.cumsum(run_size)))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.concatenate(([0], np.cumsum(run_size[place])))[:-1]
    n = begin[-1]
    when = np.arange(n) - np.repeat(begin[:-1], run_size) + np.repeat(rank, run_size)
    one, two = np.concatenate(ones), np.concatenate(twos)
    seq = np.empty(n, np.int64)
    seq[when] = np.arange(n)
    order = seq[np.argsort(one[seq], kind="stable")]
    same = one[order[1:]] == one[order[:-1]]
    if np.any(two[order[1:]][same] != two[order[:-1]][same]):
        order = np.lexsort((when, two, one))
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    out = np.zeros(n, bool)
    out[order[1:][same]] = True
    return answer(table, np.split(out, np.cumsum([len(x) for x in ones])[:-1]))


def _cut(buckets: int, block: int, words: int):
    def run(batches):
        for row in rows(batches):
            s = Slice.of(row)
            gone = np.zeros(len(s.start) + 1, np.int64)
            if row["repeats"]:
                at, h = _probe(s, block)
                start, one, _ = _candidates(s, at, replies(bucket_of(h, buckets), buckets, row["anchors"], bool), block, words)
                start = start[replies(bucket_of(one, buckets), buckets, row["repeats"], bool)]
                gone[start] += 1  # starts are distinct
                gone[start + words] -= 1
            drop = np.cumsum(gone[:-1]) > 0
            mask = np.zeros(len(s.raw) + 1, np.int8)
            mask[s.start[~drop]] = 1
            mask[s.end[~drop] + 1] -= 1
            keep = np.cumsum(mask[:-1], dtype=np.int8) > 0
            buf = s.raw.copy()
            buf[s.end] = 32
            kept = buf[keep]
            upto = np.concatenate(([0], np.cumsum(keep)))[s.byte]
            texts = [kept[i : max(i, j - 1)].tobytes() for i, j in zip(upto[:-1], upto[1:], strict=True)]
            lost = np.concatenate(([0], np.cumsum(drop)))[s.first]
            edge = np.diff(np.concatenate(([0], drop.astype(np.int8), [0])))
            begin = np.flatnonzero(edge == 1)
            stop = np.flatnonzero(edge == -1)
            # a run of covered words never spans documents unless both sides are covered; cut it at the borders
            borders = s.first[1:-1]
            inner = borders[(borders > 0) & (borders < len(drop))]
            inner = np.unique(inner[drop[inner] & drop[inner - 1]]) if len(inner) else inner
            begin, stop = np.sort(np.concatenate((begin, inner))), np.sort(np.concatenate((stop, inner)))
            of = np.searchsorted(s.first, begin, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(begin - s.first[of], pa.int64()), pa.array(stop - s.first[of], pa.int64())], ["start", "stop"])
            offsets = np.searchsorted(of, np.arange(len(s.ids) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(s.ids, pa.int64(), mask=s.ids == NULL_ID),
                "n_words": pa.array(s.count, pa.int64()),
                "n_removed": pa.array(np.diff(lost), pa.int64()),
                "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
                "spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
            })

    return run


def remove_repeats(docs: DataFrame, min_words: int = 20, block: int = 10) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_removed, kept_text and the removed spans of words."""
    if block < 1 or min_words < 2 * block - 1:
        raise ValueError("min_words must be at least 2 * block - 1, else a repeat may hold no whole block")
    buckets = bucket_count(docs)
    slices = pack(docs)
    probes = slices.mapInArrow(_send_probes(buckets, block), "sid long, bucket int, prints binary, blocks binary")
    anchors = settle(by_slice(probes.groupBy("bucket").applyInArrow(_match_anchors, ANSWER_SCHEMA), "anchors"), large=True)
    del probes
    near = slices.join(anchors, "sid").mapInArrow(_send_candidates(buckets, block, min_words), "sid long, bucket int, one binary, two binary, docs binary, runs binary")
    repeats = settle(by_slice(near.groupBy("bucket").applyInArrow(_later, ANSWER_SCHEMA), "repeats"), large=True)
    del near
    return slices.join(anchors.join(repeats, "sid"), "sid", "left").mapInArrow(_cut(buckets, block, min_words), RESULT_SCHEMA)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .runtime import read

    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
