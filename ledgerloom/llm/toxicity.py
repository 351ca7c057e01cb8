"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the presence of character 3- to 6-grams of the folded text, by hash in 2**BITS columns; none is selected or dropped.
With p = 1 + the number of toxic training texts that have a feature and q = 1 + that of the others, its log-count ratio is
log((p / sum of p) / (q / sum of q)). Features are scaled by their ratios, and L2-regularised logistic regression is fitted on them.

Training reads at most ``PER_CLASS`` labelled rows of each class and ``CELLS`` features in those of a class, in order of a hash of the row;
their feature lists come to the driver, a partition at a time, into one array of 4 bytes a feature, and the fit goes through
it ``BLOCK_CELLS`` features at a time. Every whole text is scored.

Defined cases: null and empty texts get the score of a text without features; null labels teach nothing; an id labelled
both ways counts as toxic; rows that repeat an id are rows of their own, each taught with the id's label; without both classes in the
sample the score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grams import Folded, folded_batches, id_array, slots
from .language_id import remainder
from .packed import NULL_ID
from .runtime import read, settle

SIZES = (3, 4, 5, 6)
BITS = 20
PER_CLASS = 1000
CELLS = 6_000_000
BLOCK_CELLS = 1 << 18
RIDGE = 1e-3
ROUNDS = 60
CUT = 0.7
SCHEMA = "doc_id long, score double"


class Features:
    """Distinct columns of documents, by a table of last places."""

    def __init__(self):
        self.place = np.zeros(1 << BITS, np.int32)

    def __call__(self, s: Folded):
        codes = [(n, slots(c, BITS).astype(np.int32)) for n, c in s.codes(SIZES)]
        for d in range(len(s.null)):
            h = s.of(codes, d)
            at = np.arange(len(h), dtype=np.int32)
            self.place[h] = at
            yield h[self.place[h] == at]


def _features(batches):
    made = Features()
    for ids, s in folded_batches(batches):
        rows = [np.sort(h) for h in made(s)]
        yield pa.RecordBatch.from_pydict({"key": pa.array(ids, pa.int64()), "n": pa.array([len(h) for h in rows], pa.int64()), "columns": pa.array([h.astype("<i4").tobytes() for h in rows], pa.binary())})


class Sparse:
    """A 0/1 matrix: the columns of its rows one after another, and how many each row has. Products make temporaries for ``BLOCK_CELLS`` columns (or one row) at a time."""

    def __init__(self, column: np.ndarray, size: np.ndarray, width: int):
        self.column, self.size, self.width = column, size, width
        self.first = np.concatenate(([0], np.cumsum(size))).astype(np.int64)

    def blocks(self):
        """(rows i to j, their columns)."""
        i = 0
        while i < len(self.size):
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + BLOCK_CELLS, "right")) - 1)
            yield i, j, self.column[self.first[i] : self.first[j]]
            i = j

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size))
        for i, j, column in self.blocks():
            full = i + np.flatnonzero(self.size[i:j])
            if len(full):
                out[full] = np.add.reduceat(w[column], self.first[full] - self.first[i])
        return out

    def back(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for i, j, column in self.blocks():
            np.add.at(out, column.astype(np.intp), np.repeat(e[i:j], self.size[i:j]))
        return out


def log_count_ratios(x: Sparse, y: np.ndarray) -> np.ndarray:
    p, q = 1 + x.back(y.astype(float)), 1 + x.back(1.0 - y)
    return np.log((p / p.sum()) / (q / q.sum()))


def logistic(x: Sparse, scale: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on ``x * scale`` by accelerated gradient steps; classes weigh the same. Weights are of ``x``."""
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    times = lambda w: x.times(w * scale)
    back = lambda e: x.back(e) * scale
    v = np.ones(x.width) / np.sqrt(x.width)
    for _ in range(8):  # largest curvature, by the power method
        v = back(weight * times(v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1 / (0.25 * (1.1 * top + 1) + ridge)
    w, b = np.zeros(x.width), 0.0
    pw, pb = w, b
    for t in range(rounds):
        m = t / (t + 3)
        zw, zb = w + m * (w - pw), b + m * (b - pb)
        e = weight * (1 / (1 + np.exp(-np.clip(times(zw) + zb, -40, 40))) - y)
        pw, pb = w, b
        w = zw - step * (back(e) + ridge * zw)
        b = zb - step * float(e.sum())
    return w * scale, b


class Model:
    """weights: one a column; None where nothing could be learned."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0):
        self.weights, self.bias = weights, bias

    @classmethod
    def of(cls, x: Sparse, y: np.ndarray) -> "Model":
        if not 0 < y.sum() < len(y):
            return cls(None)
        w, b = logistic(x, log_count_ratios(x, y), y)
        return cls(w.astype(np.float32), b)

    def scores(self, s: Folded, features: Features) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(s.null))
        raw = np.array([self.weights[h].sum(dtype=np.float64) for h in features(s)] + [0.0])[:-1] + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    marks = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    text = F.col("text").cast("string")
    key = F.xxhash64(F.col("doc_id").cast("long"), text).alias("key")
    taught = docs.select("doc_id", key).join(marks, "doc_id").select("key", "toxic").groupBy("key").agg(F.max("toxic").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy("key")
    chosen = taught.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PER_CLASS).select("key", "toxic").collect()
    of = {r["key"]: r["toxic"] for r in chosen}
    if len(set(of.values())) < 2:
        return Model(None)
    texts = docs.select(key, text.alias("text")).where(F.col("key").isin(list(of))).dropDuplicates(["key"])
    rows = settle(texts.mapInArrow(_features, "key long, n long, columns binary"))
    kinds = docs.sparkSession.createDataFrame(list(of.items()), "key long, toxic int")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = rows.select("key", "n").join(F.broadcast(kinds), "key").withColumn("cells", upto).where(F.col("cells") <= CELLS)  # at most 2 * PER_CLASS rows
    size_of = {r["key"]: r["n"] for r in inside.select("key", "n").collect()}
    keys = sorted(size_of)
    size = np.array([size_of[k] for k in keys], np.int64)
    first = dict(zip(keys, (np.cumsum(size) - size).tolist(), strict=True))
    column = np.zeros(int(size.sum()), np.int32)
    for r in rows.where(F.col("key").isin(keys)).select("key", "columns").toLocalIterator():  # the driver holds one partition
        column[first[r["key"]] : first[r["key"]] + size_of[r["key"]]] = np.frombuffer(r["columns"], "<i4")
    return Model.of(Sparse(column, size, 1 << BITS), np.array([of[k] for k in keys], float))


def _scorer(model):
    def run(batches):
        features = Features()
        for ids, s in folded_batches(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": id_array(ids, NULL_ID), "score": pa.array(model.value.scores(s, features), pa.float64())})

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of ``docs``: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scorer(shared), SCHEMA)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
