"""Keyword and vector search, their fusion, and the per-session cap."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_BASE = 60
_WORD = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD), lambda t: t != "")


def query_words(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", query.lower()) if t]


def query_terms(query: str) -> list[str]:
    return sorted(set(query_words(query)))


def _count(low: Column, term: str) -> Column:
    """How often the term stands in a lower-cased text, as a whole word."""
    part = r"[\p{L}\p{N}]"
    found = F.regexp_count(low, F.lit(f"(?<!{part}){re.escape(term)}(?!{part})"))
    return F.when(F.contains(low, F.lit(term)), found).otherwise(F.lit(0))  # most texts have not, and a plain search tells


def bm25(docs: DataFrame, query: str, n: int, keys: list[str], text: str = "text") -> DataFrame:
    """keys and score of the ``n`` best rows. One pass counts the query's terms, one row of corpus statistics is joined back."""
    wanted = query_terms(query)
    if not wanted:
        return docs.select(*keys, F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.col(text))
    words = docs.where(F.col(text).isNotNull()).select(*keys, F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+")).alias("dl"), *(_count(low, t).alias(f"tf{i}") for i, t in enumerate(wanted)))
    tf = [F.col(f"tf{i}") for i in range(len(wanted))]
    stats = words.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"), *(F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(tf)))
    hits = words.where(reduce(lambda a, b: a | b, [c > 0 for c in tf])).crossJoin(F.broadcast(stats))  # stats is one row
    idf = lambda i: F.log(1 + (F.col("N") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    part = lambda i: idf(i) * tf[i] * (K1 + 1) / (tf[i] + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(wanted))])
    return hits.select(*keys, score.alias("score")).orderBy(F.desc("score"), *keys).limit(n)


def bm25_postings(postings: DataFrame, n_texts: int, mean_words: float, n: int, keys: list[str]) -> DataFrame:
    """``bm25`` from the postings (term, keys, tf, dl) of the query's terms and the corpus's two numbers."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    rows = postings.join(F.broadcast(df), "term")
    idf = F.log(1 + (n_texts - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean_words)))
    return rows.groupBy(*keys).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), *keys).limit(n)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)


def learn_centroids(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Unit centroids of a sample by rounds of nearest assignment and mean; about 40 vectors a list at least."""
    sample = _unit(sample.astype(np.float32)) if len(sample) else np.zeros((1, 1), np.float32)
    k = max(1, min(lists, len(sample) // 40))
    held = sample[np.random.default_rng(5).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = (sample @ held.T).argmax(1)
        sums = np.zeros_like(held)
        np.add.at(sums, near, sample)
        empty = np.bincount(near, minlength=k) == 0
        held = np.where(empty[:, None], held, _unit(sums))
    return held


def measured_probes(sample: np.ndarray, centroids: np.ndarray, target: float, nearest: int = 10, queries: int = 200) -> tuple[int, float]:
    """The fewest lists that hold ``target`` of the true nearest of evenly spaced rows of the sample, by brute force within it, and the share of rows in them."""
    sample = _unit(sample.astype(np.float32))
    if len(sample) < 2:
        return 1, 1.0
    mine, size = (sample @ centroids.T).argmax(1), np.bincount((sample @ centroids.T).argmax(1), minlength=len(centroids))
    asked = np.unique(np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int))
    found, share = np.zeros(len(centroids)), np.zeros(len(centroids))
    for q in asked:
        near = sample @ sample[q]
        near[q] = -2
        best = np.argpartition(-near, min(nearest, len(near) - 1) - 1)[:nearest]
        order = np.argsort(-(centroids @ sample[q]), kind="stable")
        place = np.argsort(order)
        found += np.cumsum(np.bincount(place[mine[best]], minlength=len(centroids))) / len(best)
        share += np.cumsum(size[order]) / len(sample)
    enough = int(np.argmax(found / len(asked) >= target))
    return enough + 1, float(share[enough] / len(asked))


def list_of(vector: Column, centroids: np.ndarray) -> Column:
    """The list of the nearest centroid (an array of bounded size: lists times dimensions)."""

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        flat = np.asarray(v.flatten(), np.float32).reshape(len(v), -1)
        return pa.array((flat @ centroids.T).argmax(1) if len(v) else [], pa.int32())

    return nearest(vector)


def nearest_lists(centroids: np.ndarray, query: list[float], probes: int) -> list[int]:
    return np.argsort(-(centroids @ np.asarray(query)), kind="stable")[:probes].tolist() if len(centroids) else []


def cosine(vector: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(vector.cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    scale = norm * float(sum(x * x for x in query) ** 0.5)
    return F.when(scale > 0, dot / F.when(scale > 0, scale)).otherwise(F.lit(0.0))  # a zero vector is near to nothing


def vector_topk(vectors: DataFrame, query: list[float], n: int, keys: list[str], vector: str = "embedding") -> DataFrame:
    """keys and score of the ``n`` most similar rows, exactly."""
    return vectors.select(*keys, cosine(F.col(vector), query).alias("score")).orderBy(F.desc("score"), *keys).limit(n)


def rrf(lanes: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys and score: the sum of 1 / (60 + rank) over the lanes. Lanes are short (a search's limit)."""
    order = Window.orderBy(F.desc("score"), *keys)
    ranked = [lane.select(*keys, (1 / (RRF_BASE + F.row_number().over(order))).alias("part")) for lane in lanes]
    return reduce(DataFrame.unionByName, ranked).groupBy(*keys).agg(F.sum("part").alias("score"))


def diversity_cap(fused: DataFrame, keys: list[str], per: str = "session", each: int = 2, most: int = 6) -> DataFrame:
    """At most ``each`` rows of a session and ``most`` in all, best first."""
    order = Window.partitionBy(per).orderBy(F.desc("score"), *keys)
    return fused.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).drop("nth").orderBy(F.desc("score"), *keys).limit(most)


Embedder = Callable[[Column], Column]
DIM = 256


def term_place(term: str, dim: int = DIM) -> tuple[int, float]:
    """Where a term counts in a hashed vector, and with which sign."""
    h = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
    return h % dim, 1.0 - 2.0 * (h // 1_048_576 % 2)


def _hashed(words: pa.ListArray, dim: int) -> np.ndarray:
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    coded = words.flatten().dictionary_encode()
    where = [term_place(t, dim) for t in coded.dictionary.to_pylist()]  # once for each distinct term of the batch
    place, sign = np.array([w[0] for w in where], np.int64), np.array([w[1] for w in where])
    code = np.asarray(coded.indices, np.int64)
    row = np.repeat(np.arange(len(words)), np.asarray(pc.fill_null(pc.list_value_length(words), 0), np.int64))
    if not len(code):
        return np.zeros((len(words), dim))
    return np.bincount(row * dim + place[code], weights=sign[code], minlength=len(words) * dim).reshape(len(words), dim)


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """Offline embedding: signed hashed term counts as an array of ``dim`` floats; cosine normalises it. Null and wordless texts are zeros.

    Terms are cut by Spark; one Arrow function adds up the places of a whole batch, so the work is linear in the words.
    """

    @F.arrow_udf("array<float>")
    def embed(words: pa.Array) -> pa.Array:
        dense = _hashed(words, dim)
        return pa.FixedSizeListArray.from_arrays(pa.array(dense.reshape(-1), pa.float32()), dim).cast(pa.list_(pa.float32()))

    return embed(F.coalesce(terms(text), F.array().cast("array<string>")))


def embed_query(text: str, spark, embedder: Embedder = hashed_embedding) -> list[float]:
    if embedder is hashed_embedding:
        return _hashed(pa.array([query_words(text)], pa.list_(pa.string())), DIM)[0].tolist()
    return list(spark.range(1).select(embedder(F.lit(text))).first()[0])


def hybrid(texts: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], n: int, n_vec: int = 10) -> DataFrame:
    """session, seq and fused score of keyword and vector hits."""
    keys = ["session", "seq"]
    return rrf([bm25(texts, query, n, keys), vector_topk(vectors, query_vector, n_vec, keys, "vector")], keys)
