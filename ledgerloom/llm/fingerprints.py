"""Document fingerprints by I-Match, in DataFrame functions only, and their likeness.

Terms of a text: its distinct runs of ASCII letters, ASCII digits and characters beyond ASCII, lower-cased. Document
frequencies are counted over all documents. The lexicon is the terms whose inverse document frequency lies in a band: a
term is kept if N / rare <= df <= N / common. The lexicon is dealt into ``subsets`` random subsets by a hash of the term,
so a changed word breaks one subset and leaves the others. For each subset a text has terms of, its sorted terms are
hashed; the fingerprint is the list of (subset, hash) in order, ten characters each. Likeness of two fingerprints: equal
entries over subsets that either has.

Defined cases: a text of at most ``short`` terms keeps all of them, whatever their frequency; a text left without any is
one entry, the hash of the text, so equal texts always have equal fingerprints. Null texts are empty ones. Repeated
doc_ids are documents of their own, ordered by text; null doc_ids come last. An empty table gives no rows. Other columns
are ignored.

Scale: the lexicon has at most ``rare`` times the mean number of terms of a text, whatever the size of the corpus, and is
broadcast only if its counted size is below ``BROADCAST_TERMS``; else it is joined by shuffle. The next document is found
in buckets of neighbouring ids (quantiles, at most ``BUCKETS``): each bucket also gets a copy of the first row of the next
one, so one exchange of the texts serves both the neighbour's text and the grouping of the terms.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import bounded, file_bytes, read, settle, shuffle_partitions

RARE, COMMON = 200, 5
SHORT = 32
SUBSETS = 64
BUCKETS = 1 << 16
BUCKET_BYTES = 8 << 20
BROADCAST_TERMS = 1_000_000
_FIRST = -(1 << 63)
_APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), _APART)), "")


def lexicon(docs: DataFrame, rare: int = RARE, common: int = COMMON, subsets: int = SUBSETS) -> DataFrame:
    """word, subset: the terms of the band, by document frequency over all of ``docs`` (text)."""
    n = docs.count()
    count = docs.select(F.explode(terms(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    band = count.where((F.col("df") * rare >= n) & (F.col("df") * common <= n))
    return settle(band.select("word", subset_of(F.col("word"), subsets).alias("subset")))


def subset_of(word: Column, subsets: int) -> Column:
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 6), 16, 10).cast("int") % subsets).cast("int")


def entries(sides: DataFrame, keys: list[str], words: DataFrame, short: int = SHORT, subsets: int = SUBSETS) -> DataFrame:
    """keys, digest (sha256) and fingerprint entries of each row's ``text`` (not null). Keys name one row each."""
    found = sides.select(*keys, F.col("text"), terms(F.col("text")).alias("found"))
    # the text's digest goes along as an entry of its own: it starts with a space, which no term does
    marked = F.array_append("found", F.concat(F.lit(" "), F.sha2(F.col("text").cast("binary"), 256)))
    spread = found.select(*keys, (F.size("found") <= short).alias("all"), F.explode(marked).alias("term"))
    mark = F.col("term").startswith(" ")
    kept = spread.join(bounded(words, BROADCAST_TERMS), F.col("term") == F.col("word"), "left").where(mark | F.col("all") | F.col("word").isNotNull())
    part = F.when(mark, -1).otherwise(F.coalesce("subset", subset_of(F.col("term"), subsets)))
    lists = kept.select(*keys, part.alias("part"), "term").groupBy(*keys, "part").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("line"))
    entry = F.when(F.col("part") < 0, F.col("line")).otherwise(F.concat(F.lpad(F.hex(F.col("part").cast("long")), 2, "0"), F.substring(F.md5(F.col("line").cast("binary")), 1, 8)))
    whole = lists.select(*keys, entry.alias("entry")).groupBy(*keys).agg(F.array_sort(F.collect_list("entry")).alias("all"))
    digest = F.substring(F.element_at("all", 1), 2, 64)
    rest = F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    return whole.select(*keys, digest.alias("digest"), F.when(F.size("all") > 1, rest).otherwise(F.array(F.concat(F.lit("--"), F.substring(digest, 1, 8)))).alias("entries"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets either has whose hashes are equal; lists of entries."""
    subset = lambda x: F.substring(x, 1, 2)
    either = F.size(F.array_union(F.transform(a, subset), F.transform(b, subset)))
    return F.size(F.array_intersect(a, b)).cast("double") / either


def _bounds(docs: DataFrame) -> list[int]:
    """Ids that cut ``docs`` (id) into buckets of about equal numbers of rows; at most ``BUCKETS``."""
    size = file_bytes(docs)
    wanted = min(BUCKETS, max(4 * shuffle_partitions(docs.sparkSession), -(-(size or 0) // BUCKET_BYTES)))
    points = F.from_json(F.lit(json.dumps([(i + 1) / wanted for i in range(wanted - 1)])), "array<double>")
    cut = docs.agg(F.percentile_approx("id", points, 20 * wanted)).first()[0]
    return sorted(set(cut or []))


def _bucket(bounds: list[int]) -> Column:
    """How many bounds are below the id, by bisection."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    here = lambda at, step: F.coalesce(F.get(held, at + step - 1) < F.col("id"), F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(here(at, step), at + step).otherwise(at)) if bounds else F.lit(0)


def in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in buckets: bucket, place, guest, doc_id, text, next_text, by descending doc_id.

    Guests are copies of the next bucket's first rows, the first bucket's after the last one; only the last guest lacks its next text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(_FIRST)))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("id"))
    bucket = _bucket(_bounds(ids))
    tops = ids.select("id", bucket.alias("b")).groupBy("b").agg(F.max("id").alias("top"))  # a row a bucket
    line = Window.partitionBy(F.lit(0)).orderBy("b")
    above = F.coalesce(F.lead("b").over(line), F.first("b").over(line))
    tops = settle(tops.select("top", above.alias("host")))
    rows = rows.join(F.broadcast(tops), F.col("id") == F.col("top"), "left").withColumn("b", bucket)  # at most BUCKETS rows
    own = F.struct(F.col("b").alias("bucket"), F.lit(False).alias("guest"))
    copies = F.when(F.col("top").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))))
    rows = rows.withColumn("at", F.explode(copies)).select("at.*", "id", "doc_id", "text")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("id"), F.desc_nulls_last("doc_id"), "text")
    return rows.select("bucket", "guest", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame, rare: int = RARE, common: int = COMMON, short: int = SHORT, subsets: int = SUBSETS) -> DataFrame:
    """doc_id, digest and fingerprint of each row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    made = entries(rows, ["row", "doc_id"], lexicon(rows, rare, common, subsets), short, subsets)
    return made.select("doc_id", "digest", F.array_join("entries", "").alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, rare: int = RARE, common: int = COMMON, short: int = SHORT, subsets: int = SUBSETS) -> DataFrame:
    """Fingerprints of the documents and of their edits: the last half of a text gives way to the next document's first characters."""
    words = lexicon(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), rare, common, subsets)
    rows = in_order(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), edited.alias("text")))
    sides = F.when(F.col("guest"), F.slice(sides, 1, 1)).otherwise(sides)
    keys = ["bucket", "place", "guest", "doc_id", "n_chars"]
    made = entries(rows.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*"), [*keys, "side"], words, short, subsets)
    side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    both = made.groupBy(*keys).agg(side(0, "entries").alias("own"), side(1, "entries").alias("other"), side(1, "digest").alias("edited_sha256"))
    order = Window.partitionBy("bucket").orderBy("place")
    both = both.withColumn("next", F.lead("own").over(order)).where(~F.col("guest"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own", "").alias("fingerprint"), F.array_join("other", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS place, doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT place, doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY place), first_value(text) OVER (ORDER BY place)) AS next_text,
             count(*) OVER () AS n FROM d),
sides AS (SELECT place, 0 AS side, text FROM e
          UNION ALL SELECT place, 1, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) FROM e),
found AS (SELECT place, side, sha256(text) AS sha, list_distinct(regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')) AS found FROM sides),
spread AS (SELECT place, side, len(found) <= {SHORT} AS short, unnest(found) AS word FROM found),
lex AS (SELECT word FROM spread WHERE side = 0 GROUP BY word HAVING count(*) * {RARE} >= (SELECT count(*) FROM d) AND count(*) * {COMMON} <= (SELECT count(*) FROM d)),
kept AS (SELECT place, side, word, CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) % {SUBSETS} AS part FROM spread WHERE short OR word IN (SELECT word FROM lex)),
parts AS (SELECT place, side, upper(lpad(printf('%x', part), 2, '0')) || substr(md5(string_agg(word, ' ' ORDER BY word)), 1, 8) AS entry FROM kept GROUP BY place, side, part),
lists AS (SELECT f.place, f.side, any_value(sha) AS sha, coalesce(list(entry ORDER BY entry) FILTER (entry IS NOT NULL), ['--' || substr(any_value(sha), 1, 8)]) AS entries
          FROM found f LEFT JOIN parts p ON f.place = p.place AND f.side = p.side GROUP BY f.place, f.side),
twins AS (SELECT e.doc_id, e.n_chars, e.place, b.sha AS edited_sha256, a.entries AS own, b.entries AS other
         FROM e JOIN lists a ON a.place = e.place AND a.side = 0 JOIN lists b ON b.place = e.place AND b.side = 1),
ring AS (SELECT *, coalesce(lead(own) OVER (ORDER BY place), first_value(own) OVER (ORDER BY place)) AS following FROM twins)
SELECT doc_id, n_chars, edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(other, '') AS edited_fingerprint,
       len(list_intersect(own, other)) / len(list_distinct(list_concat(list_transform(own, lambda x: substr(x, 1, 2)), list_transform(other, lambda x: substr(x, 1, 2))))) AS near_edited,
       len(list_intersect(own, following)) / len(list_distinct(list_concat(list_transform(own, lambda x: substr(x, 1, 2)), list_transform(following, lambda x: substr(x, 1, 2))))) AS near_next
FROM ring
"""
