"""Language identification with blended-spectrum string kernels.

k(x, z) is the number of character 1-, 2- and 3-grams both texts have (presence, not counts; exact, nothing is hashed), over the
geometric mean of the numbers each has. ``LANDMARKS`` training texts span a Nyström feature space; kernel ridge regression in it,
one language against the rest, is a closed-form solve on the driver. Scoring is two matrix products a batch: presence of the
landmarks' grams times which landmark has them, then times coefficients.

Every non-null language is learned. Training reads at most ``PER_LANGUAGE`` rows of each, and fewer (one at least) where the
languages are so many that this would be over ``TRAINING_ROWS`` in all, chosen by hash of the row; the grams of the landmarks and
one kernel value a landmark of each training row come to the driver.
Nothing else is bounded: every whole text is scored.

Defined cases: a null text or one without any letter is ``und`` with score 0, as is everything when nothing can be
learned from; null languages teach nothing; rows that repeat an id are rows of their own, in training (each with its own text and
language) and in scoring; an empty table gives an empty result; other columns are ignored or kept. Equal scores go to the
language first in code point order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grams import Distinct, Folded, folded_batches, id_array
from .packed import NULL_ID, batch_slices
from .runtime import read, settle

SIZES = (1, 2, 3)
LANDMARKS = 96
PER_LANGUAGE = 500
TRAINING_ROWS = 64 * PER_LANGUAGE
RIDGE = 1e-4
MATRIX_CELLS = 1 << 21
SCHEMA = "doc_id long, lang_pred string, score double"


def remainder(doc_id: str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


class Landmarks:
    """Grams of the landmarks, sorted, and which landmark has them, scaled to unit norm."""

    def __init__(self, sets: list[np.ndarray]):
        self.grams = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.member = np.zeros((len(self.grams), len(sets)), np.float32)
        for i, x in enumerate(sets):
            self.member[np.searchsorted(self.grams, x), i] = 1 / np.sqrt(max(len(x), 1))

    def kernels(self, s: Folded):
        """(first document, kernel values with each landmark) of runs of documents."""
        codes, distinct = s.codes(SIZES), Distinct()
        docs, width = len(s.null), max(len(self.grams), 1)
        step = max(1, MATRIX_CELLS // width)
        for i in range(0, docs, step):
            j = min(i + step, docs)
            presence, norm = np.zeros((j - i, width), np.float32), np.ones(j - i, np.float32)
            for d in range(i, j):
                x = distinct(s.of(codes, d))
                if len(x) and len(self.grams):
                    at = np.minimum(np.searchsorted(self.grams, x), width - 1)
                    presence[d - i, at[self.grams[at] == x]] = 1
                    norm[d - i] = np.sqrt(len(x))
            yield i, presence[:, : len(self.grams)] @ self.member / norm[:, None]


def _gram_sets(batches):
    distinct = Distinct()
    for ids, s in folded_batches(batches):
        codes = s.codes(SIZES)
        yield pa.RecordBatch.from_pydict({"key": pa.array(ids, pa.int64()), "grams": pa.array([distinct(s.of(codes, d)).astype("<u8").tobytes() for d in range(len(ids))], pa.binary())})


def _kernel_rows(landmarks):
    def run(batches):
        for ids, s in folded_batches(batches):
            for i, k in landmarks.value.kernels(s):
                yield pa.RecordBatch.from_pydict({"key": pa.array(ids[i : i + len(k)], pa.int64()), "k": pa.array([r.astype("<f4").tobytes() for r in k], pa.binary())})

    return run


def training_rows(docs: DataFrame, usable: Column, count: int = LANDMARKS) -> tuple[Landmarks, np.ndarray, np.ndarray, list[str]]:
    """Landmarks, kernel values of the bounded sample in a fixed order, which of its rows are landmarks, and its languages."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    key = F.xxhash64(F.col("doc_id").cast("string"), "lang", text)  # of a row: equal rows are one
    narrow = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & text.isNotNull()).select(key.alias("key"), "lang")
    languages = narrow.select("lang").distinct().count()
    each = max(1, min(PER_LANGUAGE, TRAINING_ROWS // max(1, languages)))
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy("key"))
    chosen = narrow.withColumn("r", place).where(F.col("r") <= each).select("key", "lang", "r").distinct().collect()
    of = {r["key"]: r["lang"] for r in chosen}
    marks = {r["key"] for r in chosen if r["r"] <= max(1, count // max(1, languages))}
    if not of:
        return Landmarks([]), np.zeros((0, 0), np.float32), np.zeros(0, bool), []
    texts = settle(docs.select(key.alias("key"), text.alias("text")).where(F.col("key").isin(list(of))).dropDuplicates(["key"]))
    sets = sorted((r["key"], bytes(r["grams"])) for r in texts.where(F.col("key").isin(list(marks))).mapInArrow(_gram_sets, "key long, grams binary").collect())
    landmarks = Landmarks([np.frombuffer(g, "<u8") for _, g in sets if g])
    marks = {k for k, g in sets if g}
    got = sorted((r["key"], bytes(r["k"])) for r in texts.mapInArrow(_kernel_rows(spark.sparkContext.broadcast(landmarks)), "key long, k binary").collect())
    k = np.frombuffer(b"".join(b for _, b in got), "<f4").reshape(len(got), -1)
    return landmarks, k, np.array([i in marks for i, _ in got]), [of[i] for i, _ in got]


class Model:
    """Landmarks, coefficients and languages."""

    def __init__(self, landmarks: Landmarks, k: np.ndarray, is_mark: np.ndarray, langs: list[str], ridge: float = RIDGE):
        self.langs = sorted(set(langs)) if landmarks.member.shape[1] else []
        if not self.langs:
            return
        self.landmarks, y = landmarks, np.array(langs, object)
        value, vector = np.linalg.eigh(k[is_mark].astype(np.float64))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        phi = np.column_stack([k @ root, np.ones(len(k))])
        # each class counts the same
        weight = np.zeros(len(y))
        for lang in self.langs:
            weight[y == lang] = 1 / (y == lang).sum()
        left = (phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1])
        names, right = np.array(self.langs, object), []
        for i in range(0, len(names), 64):
            target = np.where(y[:, None] == names[None, i : i + 64], 1.0, -1.0)
            right.append((phi * weight[:, None]).T @ target)
        b = np.linalg.solve(left, np.concatenate(right, axis=1))
        self.coefficients, self.bias = (root @ b[:-1]).astype(np.float32), b[-1].astype(np.float32)

    def predict(self, s: Folded) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each document of a slice."""
        pred, score = np.full(len(s.null), "und", object), np.zeros(len(s.null))
        letters = s.has_letter() & ~s.null
        if self.langs:
            for i, k in self.landmarks.kernels(s):
                f = k @ self.coefficients + self.bias
                best = f.argmax(axis=1)
                pred[i : i + len(k)] = np.array(self.langs, object)[best]
                score[i : i + len(k)] = np.clip((f[np.arange(len(k)), best] + 1) / 2, 0, 1)
        pred[~letters], score[~letters] = "und", 0
        return pred, score


def _scorer(model):
    def run(batches):
        for ids, s in folded_batches(batches):
            pred, score = model.value.predict(s)
            yield pa.RecordBatch.from_pydict({"doc_id": id_array(ids, NULL_ID), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    return run


def fit(docs: DataFrame, usable: Column) -> Model:
    return Model(*training_rows(docs, usable))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of ``docs``: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scorer(shared), SCHEMA)


def _keeper(model, at: int):
    def run(batches):
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for _, lens, buf in batch_slices(pa.array(np.arange(batch.num_rows)), batch.column(at)):
                s = Folded(lens, buf)
                keep.append(model.value.predict(s)[0] != "und" if model.value.langs else s.has_letter() & ~s.null)
            yield batch.filter(pa.array(np.concatenate(keep).astype(bool), pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is in some language: not null, and with a letter, whether or not a language was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.withColumn("text", F.col("text").cast("string"))
    return kept.mapInArrow(_keeper(shared, docs.columns.index("text")), kept.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, remainder("doc_id", 5) != 0)
    return identify(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
