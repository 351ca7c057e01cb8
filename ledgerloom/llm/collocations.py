"""Phrase collocations: frequent phrases of 2 to 4 words whose parts seldom stand apart, for each language.

Texts are cut into slices of one language (about ``SLICE_BYTES``) of coded words. Word counts of all slices give the
dictionary of frequent words, an id each; rarer words break a piece, as no frequent phrase holds one. Phrases are ids
packed into keys of fixed width (two 64-bit numbers of two ids each). A task sorts the keys of its slices by radix, about
``HELD_KEYS`` at a time, and counts runs; these are dealt into buckets by a hash of the key, packed as differences of sorted keys, and added up by bucket. Each
step's files go as soon as the next step has what it needs of them. Words
of three and four follow pairs: a longer phrase is looked at only where all its pairs may be frequent, which a bitmap of
the frequent pairs' hashes tells (it has no misses; its false hits cost time only). Above ``BITMAP_BITS`` / 16 frequent
pairs there is no bitmap and all longer phrases are counted.

Score of a cut after k words: floor(2000000 a / (l + r)), in decimals of 38 digits; the lowest-scoring cut counts, ties to
the smallest k. A candidate is dropped if a longer one holds it and has ``share`` of its count. Null languages are `und`, null
texts empty; an empty table has no phrases; repeated rows count as often as they stand there; other columns are ignored.

No key is hot: a slice sends each of its words and phrases once. Tables of parts are joined with a broadcast only below a
counted size, else by shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import LOWER, by_bucket, joined, mix, rows, text_column
from .runtime import bounded, bucket_count, read, settle

SLICE_BYTES = 4 << 20
HELD_BYTES = 32 << 20  # of all languages of a task that wait for a full slice
HELD_KEYS = 3 << 20  # keys a task merges before it sends them
LEAST, SHARE, MOST = 30, 80, 2000
KEY_BYTES = 4 << 20  # of input a bucket of keys
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20
BITMAP_BITS = 1 << 27
SALTS = 32

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _PIECE.copy()
_APART[[0x20, 0x09]] = True


def coded(buf: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a buffer of texts, how often each stands there, and the words' codes with -1 between pieces."""
    low = LOWER[buf]
    word = ~_APART[low]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low[word]))])
    made = flat.dictionary_encode()
    code = np.asarray(made.indices, np.int32)
    breaks = np.concatenate(([0], np.cumsum(_PIECE[low], dtype=np.int64)))
    apart = np.flatnonzero(breaks[start[1:]] != breaks[end[:-1]]) + 1
    return made.dictionary, np.bincount(code, minlength=len(made.dictionary)), np.insert(code, apart, -1).astype(np.int32)


SLICES = "sid long, lang string, words array<string>, counts array<long>, codes binary"


def _slices(batches):
    part, n, zip_ = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def row(lang):
        nonlocal n
        words, counts, codes = coded(np.concatenate(held.pop(lang)))
        size.pop(lang)
        n += 1
        values = [[(part << 20) + n - 1], [lang], [words.to_pylist()], [counts.tolist()], [zip_.compress(codes.tobytes())]]
        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["sid", "lang", "words", "counts", "codes"])

    for batch in batches:
        coded_lang = batch.column(0).dictionary_encode()
        index = np.asarray(coded_lang.indices)
        for i, lang in enumerate(coded_lang.dictionary.to_pylist()):
            at, data, _ = text_column(batch.column(1).take(pa.array(np.flatnonzero(index == i))))
            lens = np.diff(at)
            for j in range(0, len(lens), 256):
                buf = joined(at, data, lens, j, min(j + 256, len(lens)))
                held.setdefault(lang, []).append(buf)
                size[lang] = size.get(lang, 0) + len(buf)
                if size[lang] >= SLICE_BYTES:
                    yield row(lang)
        while sum(size.values()) > HELD_BYTES:
            yield row(max(size, key=size.get))
    for lang in list(held):
        yield row(lang)


def slices(docs: DataFrame) -> DataFrame:
    """Coded slices of ``docs`` (lang, text), written once."""
    rows_ = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return settle(rows_.mapInArrow(_slices, SLICES))


def _numbered(table: DataFrame) -> DataFrame:
    """``table`` with ``id``: 1, 2, ... without gaps, by a prefix sum over its partitions."""
    table = settle(table.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return table.join(F.broadcast(first), part == F.col("part")).withColumn("id", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "first", "at")


def word_counts(made: DataFrame) -> DataFrame:
    spread = made.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    return spread.groupBy("lang", "word").agg(F.sum("c").alias("f"))


def _ids_of(codes: bytes, id_: np.ndarray, zip_, unzip) -> pa.RecordBatch:
    """Codes as ids; the last entry of ``id_`` is the break's, and one break is enough between two words."""
    ids = id_[np.frombuffer(unzip.decompress(codes), np.int32)]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    return pa.RecordBatch.from_pydict({"ids": pa.array([zip_.compress(ids[keep].tobytes())], pa.binary())})


def _encode(batches):
    zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    for row in rows(batches):
        id_ = np.zeros(row["size"] + 1, np.uint32)
        for x in row["given"] or ():
            id_[x["i"]] = x["id"]
        yield _ids_of(row["codes"], id_, zip_, unzip)


def _encode_with(dictionary):
    def run(batches):
        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        langs, words, ids = dictionary.value
        held: dict[str, dict[str, int]] = {}
        for lang, word, id_ in zip(langs.to_pylist(), words.to_pylist(), ids.to_pylist(), strict=True):
            held.setdefault(lang, {})[word] = id_
        for row in rows(batches):
            get = held.get(row["lang"], {}).get
            yield _ids_of(row["codes"], np.array([get(w, 0) for w in row["words"]] + [0], np.uint32), zip_, unzip)

    return run


def encoded(made: DataFrame, words: DataFrame) -> DataFrame:
    """Slices as ids of frequent words (lang, word, id), 0 at breaks, written once.

    A dictionary of at most ``BROADCAST_ROWS`` words and ``BROADCAST_BYTES`` goes to every task; of a larger one, each slice gets its own words' ids by a join.
    """
    n, size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        table = words.select("lang", "word", "id").toArrow()
        dictionary = made.sparkSession.sparkContext.broadcast([table.column(c).combine_chunks() for c in ("lang", "word", "id")])
        return settle(made.select("lang", "words", "codes").mapInArrow(_encode_with(dictionary), "ids binary"))
    spread = made.select("sid", "lang", F.posexplode("words").alias("i", "word"))
    given = spread.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("sid").agg(F.collect_list(F.struct("i", "id")).alias("given"))
    ready = made.select("sid", "codes", F.size("words").alias("size")).join(given, "sid", "left").select("codes", "size", "given")
    return settle(ready.mapInArrow(_encode, "ids binary"))


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by unsigned 64-bit columns, the first one most significant: 16 bits at a time, the lowest first."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (0, 16, 32, 48):
            digit = (column >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(ids: np.ndarray, n: int, likely: np.ndarray | None) -> list[np.ndarray]:
    """Keys (hi, lo) of all runs of ``n`` ids without a break; with ``likely`` (bits) only where each pair may be frequent."""
    w = ids.astype(np.uint64)
    pairs = (w[:-1] << np.uint64(32)) | w[1:]
    fine = (w[:-1] != 0) & (w[1:] != 0)
    if likely is not None:
        bit = _bit(pairs)
        fine &= (likely[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    m = len(w) - n + 1
    if m <= 0:
        return [np.zeros(0, np.uint64)] * 2
    whole = np.logical_and.reduce([fine[i : m + i] for i in range(n - 1)])
    at = np.flatnonzero(whole)
    lo = np.zeros(len(at), np.uint64) if n == 2 else w[at + 2] << np.uint64(32)
    return [pairs[at], lo | w[at + 3] if n == 4 else lo]


def _bit(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (BITMAP_BITS.bit_length() - 1))).astype(np.int64)


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """hi, lo, c of all parts, sorted by radix, equal keys as one run."""
    hi, lo, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = radix_order([hi, lo])
    hi, lo, c = hi[order], lo[order], c[order]
    first = _starts(hi, lo)
    return [hi[first], lo[first], np.add.reduceat(c, first) if len(first) else c]


def _bucket(hi: np.ndarray, lo: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hi ^ mix(lo)) % np.uint64(buckets)).astype(np.int64)


def _steps(x: np.ndarray) -> bytes:
    """Differences of neighbours, the first bytes of all numbers before the second ones: most are small, so most bytes are zero."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _unstepped(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind)[:, 0], dtype=kind)


def _phrases(sizes: list[int], likely, buckets: int):
    def emit(hi, lo, c):
        """A row a bucket that has keys: its part of a sorted run, packed."""
        zip_ = zstandard.ZstdCompressor(level=1)
        order, bounds = by_bucket(_bucket(hi, lo, buckets), buckets)
        hi, lo, c = hi[order], lo[order], c[order]
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            i, j = bounds[b], bounds[b + 1]
            parts = [zip_.compress(x) for x in (_steps(hi[i:j]), lo[i:j].view(np.uint8).reshape(-1, 8).T.tobytes(), c[i:j].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in zip(("hi", "lo", "c"), parts, strict=True)})

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        bits = None if likely is None else np.frombuffer(unzip.decompress(likely.value), np.uint8)
        runs, new = [], 0  # the first part is merged already
        for row in rows(batches):
            ids = np.frombuffer(unzip.decompress(row["ids"]), np.uint32)
            for n in sizes:
                hi, lo = _packed(ids, n, bits)
                runs.append([hi, lo, np.ones(len(hi), np.int32)])
                new += len(hi)
            if new >= HELD_KEYS:
                runs, new = [_merged(runs)], 0
                if len(runs[0][0]) >= HELD_KEYS:
                    yield from emit(*runs[0])
                    runs = []
        if runs:
            yield from emit(*_merged(runs))

    return run


def _starts(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate((np.ones(min(len(hi), 1), bool), (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))


def _counts(least: int):
    """hi, lo, f of a bucket's keys that add up to at least ``least``."""

    def run(table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        flat = lambda b, kind: np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]
        parts = []
        for r in zip(*(table.column(k) for k in ("hi", "lo", "c")), strict=True):
            hi, lo, c = (unzip.decompress(x.as_py()) for x in r)
            parts.append([_unstepped(hi, np.uint64), flat(lo, np.uint64), flat(c, np.uint32).astype(np.int64)])
        hi, lo, f = _merged(parts)
        keep = f >= least
        return pa.table({"hi": pa.array(hi[keep].view(np.int64)), "lo": pa.array(lo[keep].view(np.int64)), "f": pa.array(f[keep], pa.int64())})

    return run


def frequent(ids: DataFrame, sizes: list[int], least: int, buckets: int, likely=None) -> DataFrame:
    """hi, lo, f of the phrases of ``sizes`` words with at least ``least`` occurrences."""
    local = ids.mapInArrow(_phrases(sizes, likely, buckets), "bucket int, hi binary, lo binary, c binary")
    return settle(local.groupBy("bucket").applyInArrow(_counts(least), "hi long, lo long, f long"), large=True)


def _likely(pairs: DataFrame):
    """The bitmap of frequent pairs as a broadcast of at most ``BITMAP_BITS`` / 8 bytes, or None if they are too many for it."""
    if pairs.count() > BITMAP_BITS // 16:
        return None

    def bits(batches):
        for batch in batches:
            bit = np.unique(_bit(np.asarray(batch.column(0)).view(np.uint64)))
            yield pa.RecordBatch.from_pydict({"byte": pa.array(bit >> 3), "bits": pa.array(1 << (bit & 7))})

    where = pairs.select("hi").mapInArrow(bits, "byte long, bits long").groupBy("byte").agg(F.bit_or("bits").alias("bits"))
    table, made = where.toArrow(), np.zeros(BITMAP_BITS // 8, np.uint8)
    made[np.asarray(table.column("byte"))] = np.asarray(table.column("bits")).astype(np.uint8)
    return pairs.sparkSession.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(made.tobytes()))


def _ids() -> Column:
    """The ids of a key as an array."""
    low = lambda c: F.col(c).bitwiseAND((1 << 32) - 1)
    return F.filter(F.array(F.shiftright("hi", 32), low("hi"), F.shiftright("lo", 32), low("lo")), lambda x: x != 0)


def _key(ids: Column) -> list[Column]:
    at = lambda i: F.coalesce(F.get(ids, F.lit(i)), F.lit(0).cast("long"))
    return [F.shiftleft(at(0), 32).bitwiseOR(at(1)), F.shiftleft(at(2), 32).bitwiseOR(at(3))]


def _part(ids: Column, start: Column, n: Column) -> Column:
    part = F.slice(ids, start, n)
    return F.struct(_key(part)[0].alias("phi"), _key(part)[1].alias("plo"))


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """hi, lo, ids, a, l, r, score of each phrase (hi, lo, f) by its lowest-scoring cut."""
    counts = phrases.select("hi", "lo", "f").unionByName(words.select(F.shiftleft(F.col("id"), 32).alias("hi"), F.lit(0).cast("long").alias("lo"), "f"))
    counts = counts.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("f").alias("pf"))
    cand = phrases.select("hi", "lo", F.col("f").alias("a"), _ids().alias("ids"))
    cut = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    sides = F.array(_part(F.col("ids"), F.lit(1), F.col("k")), _part(F.col("ids"), F.col("k") + 1, F.size("ids") - F.col("k")))
    parts = cut.select("hi", "lo", "a", "k", F.posexplode(sides).alias("side", "p")).select("hi", "lo", "a", "k", "side", "p.phi", "p.plo")
    found = parts.join(bounded(counts, BROADCAST_ROWS), ["phi", "plo"]).groupBy("hi", "lo", "a", "k").agg(F.sum(F.when(F.col("side") == 0, F.col("pf"))).alias("l"), F.sum(F.when(F.col("side") == 1, F.col("pf"))).alias("r"))
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = found.groupBy("hi", "lo", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    return best.select("hi", "lo", _ids().alias("ids"), "a", "m.l", "m.r", "m.score")


def undominated(cand: DataFrame, phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """``cand`` without phrases that lie in a longer one of at least ``share`` percent of their count."""
    longer = phrases.where("lo <> 0").select("f", _ids().alias("ids"))
    spans = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.size("ids") - 1))).withColumn("s", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("m") + 1)))
    inside = spans.select(_part(F.col("ids"), F.col("s"), F.col("m")).alias("p"), "f").groupBy(F.col("p.phi").alias("hi"), F.col("p.plo").alias("lo")).agg(F.max("f").alias("over"))
    big = lambda n, c: F.lit(n) * F.col(c).cast("decimal(20,0)")
    return cand.join(inside, ["hi", "lo"], "left").where(F.col("over").isNull() | (big(100, "over") < big(share, "a"))).drop("over")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, most: int | None = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``most`` phrases of each language (all with None)."""
    made = slices(docs)
    counts = settle(word_counts(made))
    words = settle(_numbered(counts.where(F.col("f") >= least)), large=True)
    ids = encoded(made, words)
    del made
    # after the ids, as what the last query has read stays until the next one has run: the slices go with this one
    total = settle(counts.groupBy("lang").agg(F.sum("f").alias("n")), large=True)
    del counts
    buckets = bucket_count(docs, KEY_BYTES)
    pairs = frequent(ids, [2], least, buckets)
    phrases = pairs.unionByName(frequent(ids, [3, 4], least, buckets, _likely(pairs)))
    cand = undominated(scored(phrases, words), phrases, share)
    spread = cand.select("hi", "lo", "a", "l", "r", "score", F.posexplode("ids").alias("i", "id"))
    named = spread.join(bounded(words.select("id", "lang", "word"), BROADCAST_ROWS), "id").groupBy("hi", "lo", "a", "l", "r", "score")
    named = named.agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if most is not None:  # the best of each salt first, so that no language is one task
        salt = F.pmod(F.xxhash64("hi", "lo"), F.lit(SALTS))
        named = named.withColumn("salt", salt).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= most)
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(w[i + 1:i + {n}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(len(w) - {n - 1})) AS i FROM pieces WHERE len(w) >= {n})" for n in (1, 2, 3, 4))
ORACLE = f"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
             FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
grams AS (SELECT lang, size, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE f >= {LEAST}),
cand AS (SELECT * FROM often WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
parts AS (SELECT c.lang, c.size, c.phrase, c.w, c.f AS a, c.k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.f // (x.f + y.f) AS BIGINT) AS score FROM cuts c
          JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, f, w, m, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM cand)),
inside AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(f) AS top FROM spans GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.top IS NULL OR 100 * CAST(i.top AS HUGEINT) < {SHARE} * CAST(b.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= {MOST}
"""
