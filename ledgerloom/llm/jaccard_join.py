"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct word shingles. Shingles are ordered by document frequency (rare first, then by
hash), so two sets whose Jaccard similarity reaches the threshold share a shingle among the first
n - ceil(t * n) + 1 of each. Frequencies come from an exchange of packed fingerprints by hash bucket, which answers one
byte a shingle (a monotone code of the count; 0 marks a shingle of one document, which needs no posting).

1. Equal sets are one class; classes with an identical prefix and size are one group, and only groups have postings.
2. Star rounds: in each posting list every group is paired with the list's centre (fewest unique shingles), which
   is a linear number of pairs. Links found that way join classes into components.
   In each group every class is paired with one of them, too.
3. Last round: what is left are pairs of classes that share a posting or a group, pass the length and positional filters
   and are still in different components. All of these are verified, so no link between components is lost, while the
   pairs inside a component are never listed. Lists and groups of many rows are dealt over salts.

Verification intersects whole sets: the partners of one class travel to it in chunks of at most about ``CHUNK``, so
neither a large group nor a frequent shingle meets in one task.

Defined cases: null or empty text has an empty set, is linked with nothing and is its own component; fewer words than
the shingle length make one shingle of the whole sequence; A-Z are lower-cased, no other change; rows that repeat
a doc_id are documents of their own that get the component their own text belongs to; a null doc_id sorts last
(its component is the smallest doc_id there, or null if it has no other); an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packed import (ANSWER_SCHEMA, FIRST, LOWER, NULL_ID, SECOND, Slice, bucket_of, by_slice, frequency, messages, mix, pack, replies, rows)
from .runtime import bucket_count, free_name, settle

CHUNK = 256
SPLIT = 2048
STAR_ROUNDS = 2
_SETS = "rid long, doc_id long, n int, f1 long, f2 long, g long, uniq int, toks array<long>, poss array<int>, members binary"


def shingle_sets(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, by document and hash."""
    h = s.word_hash()
    at = s.windows(k)
    doc = np.searchsorted(s.first, at, "right") - 1
    short = np.flatnonzero((s.count > 0) & (s.count < k))
    start, end = np.concatenate((at, s.first[short])), np.concatenate((at + k, s.first[short + 1]))
    doc = np.concatenate((doc, short))
    x = FIRST.spans(FIRST.prefix(h), start, end) ^ mix((end - start).astype(np.uint64))
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.concatenate(([True], (np.diff(doc) != 0) | (x[1:] != x[:-1]))) if len(x) else np.zeros(0, bool)
    return doc[new], x[new]


def _send(buckets: int, k: int):
    def run(batches):
        for row in rows(batches):
            _, x = shingle_sets(Slice.of(row, LOWER), k)
            if len(x):
                yield messages(row["sid"], bucket_of(x, buckets), buckets, prints=x.astype(np.uint32))

    return run


def _segment_hash(roll, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return roll.spans(roll.prefix(values), first, last)


def _prefixes(buckets: int, k: int, num: int, den: int):
    def run(batches):
        for row in rows(batches):
            s = Slice.of(row, LOWER)
            docs = len(s.ids)
            doc, x = shingle_sets(s, k)
            df = replies(bucket_of(x, buckets), buckets, row["df"], np.uint8)
            first = np.searchsorted(doc, np.arange(docs + 1))
            n = np.diff(first)
            f1, f2 = (_segment_hash(r, x, np.minimum(first[:-1], len(x)), first[1:]) if len(x) else np.zeros(docs, np.uint64) for r in (FIRST, SECOND))
            order = np.lexsort((x, df, doc))
            rank = np.arange(len(x)) - np.repeat(first[:-1], n)
            plen = np.where(n > 0, n - (num * n + den - 1) // den + 1, 0)
            inside = rank < np.repeat(plen, n)
            g = _segment_hash(SECOND, x[order], first[:-1], first[:-1] + plen) if len(x) else np.zeros(docs, np.uint64)
            g = mix(g ^ mix(n.astype(np.uint64)))
            post = inside & (df[order] > 0)
            uniq = np.concatenate(([0], np.cumsum(df == 0)))
            offset = np.concatenate(([0], np.cumsum(post)))[first].astype(np.int32)
            has = np.diff(offset) > 0
            yield pa.RecordBatch.from_pydict({
                "rid": pa.array((row["sid"] << 20) + np.arange(docs), pa.int64()),
                "doc_id": pa.array(s.ids, pa.int64()),
                "n": pa.array(n, pa.int32()),
                "f1": pa.array(f1.view(np.int64), pa.int64()),
                "f2": pa.array(f2.view(np.int64), pa.int64()),
                "g": pa.array(g.view(np.int64), pa.int64()),
                "uniq": pa.array(uniq[first[1:]] - uniq[first[:-1]], pa.int32()),
                "toks": pa.ListArray.from_arrays(pa.array(offset), pa.array(x[order][post].view(np.int64), pa.int64())),
                "poss": pa.ListArray.from_arrays(pa.array(offset), pa.array(rank[post], pa.int32())),
                "members": pa.array([x[i:j].tobytes() if w else None for i, j, w in zip(first[:-1], first[1:], has, strict=True)], pa.binary()),
            })

    return run


def _check(num: int, den: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        a = np.frombuffer(left.column("m")[0].as_py(), np.uint64) if left.num_rows else np.zeros(0, np.uint64)
        found = []
        for node, members in zip(right.column("b"), right.column("members"), strict=True):
            b = np.frombuffer(members.as_py(), np.uint64)
            at = np.minimum(np.searchsorted(a, b), max(len(a) - 1, 0))
            both = int(np.count_nonzero(a[at] == b)) if len(a) else 0
            if den * both >= num * (len(a) + len(b) - both):
                found.append(node.as_py())
        return pa.table({"u": pa.array([key[0].as_py()] * len(found), pa.int64()), "v": pa.array(found, pa.int64())})

    return run


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b)."""
    pairs = pairs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct() if "c" not in pairs.columns else pairs.select("a", "b").where("a <> b").distinct()
    size = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / CHUNK)).cast("int").alias("chunk")
    pairs = settle(pairs.join(size, "a").select("a", "b", chunk))
    left = pairs.select(F.col("a").alias("x"), F.col("chunk").alias("c")).distinct().join(sets.select(F.col("node").alias("x"), F.col("members").alias("m")), "x")
    right = pairs.join(sets.select(F.col("node").alias("b"), "members"), "b").select(*(F.col(c).alias(c) for c in ("a", "chunk", "b", "members")))
    return settle(left.groupBy("x", "c").cogroup(right.groupBy("a", "chunk")).applyInArrow(_check(num, den), "u long, v long"))


def _group_stars(members: DataFrame, turn: int) -> DataFrame:
    """(a, b, c): the classes of each group with its centre, where they are not yet in one component."""
    centre = members.groupBy("gid").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h") if turn else F.lit(0).alias("h"), "node", "component")).alias("z"))
    rest = members.join(centre, "gid").where((F.col("node") != F.col("z.node")) & (F.col("component") != F.col("z.component")))
    return rest.select(F.col("z.node").alias("a"), F.col("node").alias("b"), F.lit(1).alias("c"))


def _joined(part: DataFrame | None, links: DataFrame) -> DataFrame:
    """Edges of the components so far and of new links."""
    return links if part is None else part.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)


def _halves(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join on ``key``: rows of a key with more than ``SPLIT`` are dealt over salts on the left and repeated for each on the right."""
    size = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("salts"))
    rows = rows.join(size, key)
    left = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts"))).drop("salts")
    right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return left, right.select(key, "salt", *(F.col(c).alias(f"{c}_2") for c in rows.columns if c not in (key, "salts")))


def jaccard_components(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, and set_id, which equal sets share."""
    t = Fraction(str(threshold))
    num, den = t.numerator, t.denominator
    buckets = bucket_count(docs)
    slices = pack(docs)
    sent = slices.mapInArrow(_send(buckets, words), "sid long, bucket int, prints binary")
    df = settle(by_slice(sent.groupBy("bucket").applyInArrow(frequency, ANSWER_SCHEMA), "df"), large=True)
    del sent
    found = settle(slices.join(df, "sid", "left").mapInArrow(_prefixes(buckets, words, num, den), _SETS), large=True)
    del slices, df

    same = ("f1", "f2", "n")
    classes = settle(found.where(F.size("toks") > 0).groupBy(*same).agg(F.min("rid").alias("node")))
    shaped = found.select("rid", "n", "g", "uniq", "toks", "poss").join(classes.select("node"), F.col("rid") == F.col("node"), "left_semi").withColumnRenamed("rid", "node")
    sets = found.where(F.size("toks") > 0).select(F.col("rid").alias("node"), "members").join(classes.select("node"), "node", "left_semi")
    groups = shaped.groupBy("g", "n").agg(F.min_by(F.struct("node", "uniq", "toks", "poss"), "node").alias("x"))
    of_group = settle(shaped.select("node", "g", "n").join(groups.select("g", "n", F.col("x.node").alias("gid")), ["g", "n"]).select("node", "gid"))
    entries = settle(
        groups.select(F.col("x.node").alias("gid"), "n", F.col("x.uniq").alias("uniq"), F.explode(F.arrays_zip(F.col("x.toks").alias("tok"), F.col("x.poss").alias("pos"))).alias("z")).select(
            "gid", "n", "uniq", F.col("z.tok").alias("tok"), F.col("z.pos").alias("pos")
        )
    )
    listed = entries.groupBy("tok").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    entries = settle(entries.join(listed, "tok", "left_semi"))

    long_enough = lambda m, n: F.lit(den) * F.least(m, n) >= F.lit(num) * F.greatest(m, n)
    alpha = lambda m, n: F.ceil((m + n) * num / F.lit(float(num + den)) - 1e-9)
    part = None
    members = of_group.withColumn("component", F.col("node"))
    for turn in range(STAR_ROUNDS):
        live = entries
        if part is not None:
            live = entries.join(part.withColumnRenamed("node", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
            open_ = live.groupBy("tok").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
            live = settle(live.join(open_, "tok", "left_semi"))
        order = F.struct(F.col("uniq") if turn % 2 == 0 else F.lit(0).alias("uniq"), F.xxhash64(F.lit(turn), "gid"), "gid", "n")
        centre = live.groupBy("tok").agg(F.min(order).alias("c")).select("tok", F.col("c.gid").alias("a"), F.col("c.n").alias("m"))
        pairs = live.join(centre, "tok").where((F.col("a") != F.col("gid")) & long_enough(F.col("m"), F.col("n"))).select("a", F.col("gid").alias("b"), F.lit(1).alias("c"))
        inner = _group_stars(members, turn)
        if turn and live.isEmpty() and inner.isEmpty():
            break
        part = settle(components(_joined(part, _verify(pairs.unionByName(inner), sets, num, den))), large=True)
        members = settle(of_group.join(part, "node", "left").withColumn("component", F.coalesce("component", "node")))

    spread = members.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    live = entries.join(spread, "gid")
    open_ = live.groupBy("tok").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).where("x <> y")
    live = live.join(open_, "tok", "left_semi").join(members, "gid").select("tok", "gid", "node", "n", "pos", "component")
    n, m = F.col("n"), F.col("n_2")
    most = 1 + F.least(n - F.col("pos") - 1, m - F.col("pos_2") - 1)
    left, right = _halves(settle(live), "tok")
    pairs = left.join(right, ["tok", "salt"]).where((F.col("gid") != F.col("gid_2")) & (F.col("node") > F.col("node_2")) & (F.col("component") != F.col("component_2")) & long_enough(n, m) & (most >= alpha(n, m)))
    # classes of one group share their whole prefix, so no posting list tells them apart
    inside = members.join(spread.where("lo <> hi").select("gid"), "gid", "left_semi")
    left, right = _halves(settle(inside), "gid")
    inner = left.join(right, ["gid", "salt"]).where((F.col("node") > F.col("node_2")) & (F.col("component") != F.col("component_2")))
    ends = (F.col("node").alias("a"), F.col("node_2").alias("b"))
    pairs = settle(pairs.select(*ends).unionByName(inner.select(*ends)).distinct())
    if not pairs.isEmpty():
        part = settle(components(_joined(part, _verify(pairs, sets, num, den))), large=True)

    placed = classes.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rowwise = found.select("rid", "doc_id", *same).join(placed, list(same), "left").withColumn("component", F.coalesce("component", "rid"))
    least = rowwise.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return rowwise.join(least, "component").select(back("doc_id"), F.col("n").cast("long").alias("n_shingles"), back("component_id"), F.coalesce("node", "rid").alias("set_id"))


def one_of_each(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near duplicates keeps one row: the one with the smallest doc_id.

    Rows with an empty set are in no group and all stay. Rows are told apart by a hash of doc_id and text, so rows that repeat
    an id are judged by their own text, and whole repeats leave one row.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = jaccard_components(docs.select(key.alias("doc_id"), "text"), words, threshold).where("n_shingles > 0")
    found = settle(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("c")))
    ids = docs.select(key.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")).distinct()
    grouped = found.join(ids, "key").groupBy("c").agg(F.min(F.struct("id", "key")).alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1")
    headed = settle(found.join(grouped.select("c", F.col("head.key").alias("stays")), "c"))
    own, other = free_name(docs, "own"), free_name(docs, "other")
    gone = headed.where("key <> stays").select(F.col("key").alias(other)).distinct()
    twice = settle(headed.where("key = stays").groupBy("key").count().where("count > 1").select(F.col("key").alias(other)))
    keyed, met = docs.withColumn(own, key), F.col(own) == F.col(other)
    if twice.isEmpty():
        return keyed.join(gone, met, "left_anti").drop(own)
    rest = keyed.join(gone.unionByName(twice), met, "left_anti")
    once = keyed.join(twice, met, "left_semi").dropDuplicates([own])
    return rest.unionByName(once).drop(own)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .runtime import read

    return jaccard_components(read(spark, sf_dir, "documents"), words=4, threshold=0.85).select("doc_id", "n_shingles", "component_id", "set_id")
