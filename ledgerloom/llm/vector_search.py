"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking.

Largest inner products become smallest angles: each vector is divided by the largest norm M and gets one more component
sqrt(1 - |x|^2 / M^2), unless all norms are alike; queries are normalised and get 0 there. A hash rotates a unit vector with three rounds of random
signs and a fast Hadamard transform (dimension padded to a power of two) and names the nearest of the 2 * D signed
axes. The index keeps ``AXES`` such hashes of every row. Tables are made of them singly or in pairs, and a query probes its
likeliest buckets in each table, in the order of lost squared axis length. How many is measured: for ``SAMPLE`` queries the
true neighbours among all rows are found by an exact pass, and of the steps of ``LADDER`` that find ``RECALL`` of them the one
that probes the smallest share of ``SHARE_ROWS`` sampled rows is taken (the one of highest recall if none does); ``tune`` reports recall
and share. Every row found in any probed bucket is reranked by the exact inner product in double precision.

The index is a DataFrame (id, vector, hashes), written once. Probes of queries are made by the executors. Queries go over the
index in blocks, each broadcast with its probes (``BLOCK_BYTES`` at most; the driver only puts them together); a task looks up its own
rows' buckets and keeps its k best of each query, and a ranked window merges those. Buckets have no cap: a bucket of a third of all rows lies in as many tasks as its
rows do, and no pairs are shuffled.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part as query or
row; vectors of different lengths have no inner product, so each length is searched by itself; equal scores go to the smaller id;
rows that repeat an id are rows and queries of their own, and none of them is a candidate of a query with that id;
fewer candidates than k give all; empty tables give no rows.
A query whose probed buckets hold fewer than k rows is completed by an exact pass over all rows.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import read, settle

AXES = 48
LADDER = tuple((2, 1 << i) for i in range(4, 10)) + ((2, 96), (2, 192), (2, 384)) + tuple((1, i) for i in (1, 2, 3, 4, 6, 8, 12))  # hashes a table, probes a table
RECALL = 0.94
SAMPLE = 96
SHARE_ROWS = 4096
WIDE = 32  # likeliest axes of each hash from which pairs are made
BLOCK_BYTES = 16 << 20
ROWS = 65536
SEED = 7
EVEN = 1e-3  # squared norms this near to each other need no further component
log = logging.getLogger(__name__)
SCHEMA = "q int, query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of rows."""
    n = x.shape[1]
    h = 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


class Hashes:
    def __init__(self, dim: int, count: int, seed: int):
        self.dim_in = dim
        self.dim = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (count, 3, self.dim))

    def rotated(self, x: np.ndarray, which: int) -> np.ndarray:
        """Inner products with the 2 * D signed axes after one pseudo-rotation."""
        out = np.zeros((len(x), self.dim), np.float32)
        out[:, : x.shape[1]] = x
        for signs in self.signs[which]:
            out = hadamard(out * signs)
        return np.concatenate((out, -out), axis=1)

    def axes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.rotated(x, i).argmax(axis=1) for i in range(len(self.signs))]).astype(np.int32)

    def buckets(self, axes: np.ndarray, hashes: int) -> np.ndarray:
        """Bucket of each row in each table."""
        return axes if hashes == 1 else axes[:, 0::2] * (2 * self.dim) + axes[:, 1::2]

    def probes(self, x: np.ndarray, hashes: int, most: int) -> np.ndarray:
        """The ``most`` likeliest buckets of each row in each table, likeliest first."""
        if hashes == 1:
            most = min(most, 2 * self.dim)
            return np.stack([np.argsort(-self.rotated(x, i), axis=1, kind="stable")[:, :most] for i in range(len(self.signs))], axis=1).astype(np.int32)
        wide = min(WIDE, 2 * self.dim)
        a, b = np.divmod(np.arange(wide * wide), wide)
        early = (a + 1) * (b + 1) <= most  # a pair comes after all pairs of better axes
        a, b = a[early], b[early]
        out = []
        for i in range(0, len(self.signs), 2):
            best, lost = [], []
            for j in (i, i + 1):
                r = self.rotated(x, j)
                o = np.argsort(-r, axis=1, kind="stable")[:, :wide]
                best.append(o)
                lost.append((r.max(axis=1)[:, None] - np.take_along_axis(r, o, 1)) ** 2)
            pick = np.argsort(lost[0][:, a] + lost[1][:, b], axis=1, kind="stable")[:, :most]
            code = best[0][:, a] * (2 * self.dim) + best[1][:, b]
            out.append(np.take_along_axis(code, pick, 1))
        return np.stack(out, axis=1).astype(np.int32)


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def _lifted(hashes: Hashes, x: np.ndarray) -> np.ndarray:
    """Queries as unit vectors of the index's dimension."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return np.column_stack((unit, np.zeros(len(unit)))) if hashes.dim_in > x.shape[1] else unit


def _index(hashes: Hashes, dim: int, top: float):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = np.array(part.column(1).to_pylist(), np.float64).reshape(-1, dim)
                unit = x / top
                if hashes.dim_in > dim:
                    unit = np.column_stack((unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1)))))
                axes = hashes.axes(unit)
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "v": pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), "axes": pa.array([c.astype("<u2").tobytes() for c in axes], pa.binary())})

    return run


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= edge)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


def _search(block, made: Hashes, hashes: int, dim: int, k: int, exact: bool):
    def run(batches):
        numbers, q_ids, q, tables = block.value

        def scored(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
            ids, x, axes = (np.concatenate(c) for c in zip(*rows, strict=True))
            buckets = []
            if not exact:
                codes = made.buckets(axes.astype(np.int32), hashes)
                for t in range(codes.shape[1]):
                    order = np.argsort(codes[:, t], kind="stable")
                    buckets.append((order, codes[order, t]))
            out = []
            for i, q_id in enumerate(q_ids):
                if exact:
                    near = np.arange(len(ids))
                else:
                    seen = np.zeros(len(ids), bool)
                    for t, (order, code) in enumerate(buckets):
                        lo, hi = np.searchsorted(code, tables[i, t], "left"), np.searchsorted(code, tables[i, t], "right")
                        size = hi - lo
                        full = size > 0
                        size, lo = size[full], lo[full]
                        seen[order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
                    near = np.flatnonzero(seen)
                near = near[ids[near] != q_id]
                if len(near):
                    score = np.einsum("ij,j->i", x[near], q[i])
                    best = _best(score, ids[near], k)
                    out.append((np.full(len(best), numbers[i]), np.full(len(best), q_id), ids[near][best], score[best]))
            if out:
                n, a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"q": pa.array(n, pa.int32()), "query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

        held, size = [], 0
        for batch in batches:
            n = batch.num_rows
            part = (np.asarray(batch.column(0), np.int64), np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f8").reshape(n, dim), np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(n, -1))
            held.append(part)
            size += n
            if size >= ROWS:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _probing(made: Hashes, hashes: int, most: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = np.array(part.column(1).to_pylist(), np.float64)
                probes = made.probes(_lifted(made, x), hashes, most).astype("<i4")
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "v": pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), "probes": pa.array([p.tobytes() for p in probes], pa.binary())})

    return run


def _blocks(probed: DataFrame, size: int):
    held = []
    for row in probed.toLocalIterator(prefetchPartitions=True):
        held.append((row["id"], bytes(row["v"]), bytes(row["probes"])))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def tune(index: DataFrame, made: Hashes, queries: DataFrame, dim: int, k: int) -> tuple[int, int, float, float] | None:
    """(hashes a table, probes a table, measured recall, share of rows probed) of the step of the ladder to take; None without queries."""
    spark = index.sparkSession
    sample = queries.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
    if not sample:
        return None
    ids, q = np.array([s["id"] for s in sample], np.int64), np.array([s["v"] for s in sample], np.float64)
    true = _ranked(index.mapInArrow(_search(spark.sparkContext.broadcast((np.arange(len(ids)), ids, q, None)), made, 1, dim, k, True), SCHEMA), k)
    true = true.join(index.select(F.col("id").alias("vec_id"), "axes"), "vec_id").select("q", "axes").collect()
    rows = index.orderBy(F.xxhash64("id", "v")).limit(SHARE_ROWS).select("axes").collect()
    if not true:
        return (*LADDER[0], 1.0, 0.0)
    decoded = lambda column: np.array([np.frombuffer(r, "<u2") for r in column]).astype(np.int32)
    of, axes, others = np.array([r["q"] for r in true]), decoded(r["axes"] for r in true), decoded(r["axes"] for r in rows)
    found = []
    for hashes, most in LADDER:
        if hashes == 2 and most > (2 * made.dim) ** 2 // 4 or hashes == 1 and most > 2 * made.dim // 4:
            continue  # a quarter of all buckets of each table is no index
        probes, bucket, other = made.probes(_lifted(made, q), hashes, most), made.buckets(axes, hashes), made.buckets(others, hashes)
        recall = np.mean([any((probes[i, t] == b[t]).any() for t in range(len(b))) for i, b in zip(of, bucket, strict=True)])
        hit = np.zeros((len(q), len(other)), bool)
        for t in range(other.shape[1]):
            for i in range(len(q)):
                hit[i] |= np.isin(other[:, t], probes[i, t])
        found.append((hashes, most, float(recall), float(hit.mean())))
    good = [f for f in found if f[2] >= RECALL]
    return min(good, key=lambda f: f[3]) if good else max(found, key=lambda f: f[2])


def _nearest(rows: DataFrame, queries: DataFrame, dim: int, top: float, even: bool, many: int, k: int, axes: int, seed: int) -> DataFrame | None:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    made = Hashes(dim if even else dim + 1, axes, seed)
    index = settle(rows.mapInArrow(_index(made, dim, top), "id long, v binary, axes binary"))
    step = tune(index, made, queries, dim, k)
    if step is None:
        return None
    hashes, most, recall, share = step
    log.info("length %d: %d hashes a table, %d probes, recall %.3f, share of rows probed %.3f", dim, hashes, most, recall, share)
    tables = axes // hashes
    probed = settle(queries.mapInArrow(_probing(made, hashes, most), "id long, v binary, probes binary"))
    width = min(most, 2 * made.dim) if hashes == 1 else most
    size = max(1, BLOCK_BYTES // (4 * tables * width + 8 * dim))
    out, first = None, 0
    for block in _blocks(probed, size):
        ids, q = np.array([b[0] for b in block], np.int64), np.frombuffer(b"".join(b[1] for b in block), "<f8").reshape(len(block), dim)
        probes = np.frombuffer(b"".join(b[2] for b in block), "<i4").reshape(len(block), tables, -1)
        number = first + np.arange(len(block))
        shared = spark.sparkContext.broadcast((number, ids, q, probes))
        part = settle(_ranked(index.mapInArrow(_search(shared, made, hashes, dim, k, False), SCHEMA), k))
        enough = {r[0] for r in part.groupBy("q").count().where(F.col("count") >= min(k, many - 1)).select("q").collect()}
        again = np.flatnonzero([n not in enough for n in number.tolist()])
        if len(again):
            rest = spark.sparkContext.broadcast((number[again], ids[again], q[again], None))
            whole = _ranked(index.mapInArrow(_search(rest, made, hashes, dim, k, True), SCHEMA), k)
            part = part.where(~F.col("q").isin(number[again].tolist())).unionByName(whole)
        out = part if out is None else out.unionByName(part)
        first += len(block)
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_: str = "vec_id", vector: str = "embedding", axes: int = AXES, seed: int = SEED) -> DataFrame:
    """The k nearest found of each query: query_id, rank (from 1), vec_id, score."""
    rows, queries = usable(rows, id_, vector), usable(queries, id_, vector)
    norm = F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")
    shapes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.min(norm).alias("low")).orderBy("dim").collect()  # a row a length
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for s in shapes:
        of = F.size("v") == s["dim"]
        even = s["low"] > (1 - EVEN) * s["top"]  # then inner products rank as angles do
        part = _nearest(rows.where(of), queries.where(of), s["dim"], float(np.sqrt(s["top"])) * (1 + 1e-12), even, s["n"], k, axes, seed)
        if part is not None:
            out = out.unionByName(part.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return out


def op10_vector_search(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
