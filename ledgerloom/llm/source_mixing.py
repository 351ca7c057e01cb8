"""Mixing sources to target weights with Sainte-Laguë apportionment, in DataFrame operations only.

Targets: all words of all documents are shared out by the sources' weights (1, 2, 3, repeating in code point order, null
last); no target exceeds ``most`` times its source's words, and the excess goes to the others by weight (water
filling: sources in the order words / weight, capped as long as the level of the rest is above their cap).

Apportionment: the targets are cut into blocks of ``block`` words, and each block goes to the highest quotient
target / (2 * blocks so far + 1). Seats above a divisor that is surely too high are counted in closed form; only the
seats between that and one that is surely too low, about two a source, are ranked. Sources are dealt into shards by a
seeded hash (about ``shard_words`` words each, so a hot source is many cells), and each source's blocks are
apportioned to its shards the same way. Within a shard, documents lie in seeded order as one run of equal blocks: its
quota takes whole passes, then the first blocks.

Defined cases: null text has size 0 and takes nothing; null sources are one source; null doc_ids hash as one text;
repeated rows are documents of their own; without any words all targets are 0; other columns are ignored or kept.
Results depend on nothing but rows and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import free_name, read, settle

BLOCK = 16
MOST = 3
SHARD_WORDS = 1 << 20
SEED = "mix-1"


def _seats(frame: DataFrame, weight: str, seats: str, by: list[str], tie: list[Column]) -> DataFrame:
    """Adds ``won``: the blocks each row of ``frame`` gets of its group's ``seats`` in proportion to ``weight``."""
    group = Window.partitionBy(*by)
    half = F.count(F.lit(1)).over(group) / 2
    total = F.sum(F.col(weight).cast("double")).over(group)
    share = F.col(weight).cast("double")
    frame = frame.withColumns({"_half": half, "_total": total})
    high = F.when(F.col(seats) > F.col("_half"), F.floor(share * (F.col(seats) - F.col("_half")) / F.col("_total") + 0.5) - 1).otherwise(F.lit(0))
    low = F.floor(share * (F.col(seats) + F.col("_half")) / F.col("_total") + 0.5) + 1
    frame = frame.withColumns({"_sure": F.when(F.col("_total") > 0, F.greatest(high, F.lit(0))).otherwise(F.lit(0)).cast("long"), "_most": F.when(F.col("_total") > 0, low).otherwise(F.lit(0)).cast("long")})
    frame = frame.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    open_ = frame.withColumn("_k", F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most"))).otherwise(F.array(F.lit(-1).cast("long")))))
    quotient = F.when(F.col("_k") < 0, F.lit(-1.0)).otherwise(share / (2 * F.col("_k") - 1))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(quotient.desc(), *tie))
    keep = [c for c in frame.columns if c[0] != "_"]
    ranked = open_.withColumn("_won", ((place <= F.col("_left")) & (F.col("_k") > 0)).cast("long"))
    return ranked.groupBy(*keep, "_sure").agg(F.sum("_won").alias("_won")).withColumn("won", F.col("_sure") + F.col("_won")).drop("_sure", "_won")


def _targets(sizes: DataFrame, most: int, block: int) -> DataFrame:
    """A row a source: sr (its rank from 1), source, source_size, target, seats."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy("all")
    sources = sources.withColumn("all", F.lit(1)).withColumn("sr", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    sources = sources.withColumn("weight", (F.col("sr") - 1) % 3 + 1)
    before = one.orderBy(F.col("source_size") / F.col("weight"), "sr").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumns({
        "total": F.sum("source_size").over(one),
        "capped": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)),
        "rest": F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    sources = sources.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    fits = F.col("level") * F.col("weight") <= most * F.col("source_size")
    sources = sources.withColumn("level", F.min(F.when(fits, F.struct((F.col("source_size") / F.col("weight")).alias("a"), "sr", "level"))).over(one)["level"])
    sources = sources.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")))
    sources = sources.withColumn("seats", F.ceil(F.col("total") / block).cast("long"))
    won = _seats(sources.select("all", "sr", "source", "source_size", "target", "seats"), "target", "seats", ["all"], [F.col("sr")])
    return won.select("sr", "source", "source_size", "target", F.col("won").alias("seats"))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, block: int = BLOCK, most: int = MOST, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, taken."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sizes = settle(docs.select("doc_id", "source", word_count().alias("size"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h")))
    sources = settle(_targets(sizes, most, block))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    dealt = sizes.join(sources.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).withColumn("shard", F.col("h") % shards).drop("source_")
    cells = dealt.groupBy("sr", "shard").agg(F.sum("size").alias("cell"), F.first("seats").alias("seats"))
    cells = _seats(cells, "cell", "seats", ["sr"], [F.col("shard")])
    cells = cells.select("sr", "shard", "cell", F.least(F.col("won") * block, most * F.col("cell")).alias("want"))
    run = Window.partitionBy("sr", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("start", F.sum("size").over(run) - F.col("size")).join(cells, ["sr", "shard"])
    passes = F.when(F.col("cell") > 0, F.floor(F.col("want") / F.col("cell"))).otherwise(F.lit(0)).cast("long")
    laid = laid.withColumn("passes", passes).withColumn("more", F.col("want") - F.col("passes") * F.col("cell") - F.col("start"))
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("more")))
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (its taken words over its size, to the nearest whole)."""
    plan = mix_sources(docs, **options).where("taken > 0")
    plan = plan.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    plan = plan.withColumn("copies", F.round(F.col("taken") / (F.col("rows") * F.col("size"))).cast("int")).where("copies > 0")
    d, s, n, c = (free_name(docs, x) for x in ("d", "s", "n", "c"))
    plan = plan.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n), F.col("copies").alias(c))
    same = docs["doc_id"].eqNullSafe(F.col(d)) & docs["source"].eqNullSafe(F.col(s)) & (word_count() == F.col(n))
    out = docs.join(plan, same).withColumn(c, F.explode(F.sequence(F.lit(1), F.col(c))))
    return out.drop(d, s, n, c)


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _seats_sql(frame: str, weight: str, seats: str, by: str, tie: str, keep: str) -> str:
    """The same apportionment in DuckDB's SQL, over a relation."""
    w, s = f"CAST({weight} AS DOUBLE)", seats
    return f"""(
      WITH a AS (SELECT *, count(*) OVER (PARTITION BY {by}) / 2.0 AS _half, sum({w}) OVER (PARTITION BY {by}) AS _total FROM {frame}),
      b AS (SELECT *, CAST(CASE WHEN _total > 0 AND {s} > _half THEN greatest(floor({w} * ({s} - _half) / _total + 0.5) - 1, 0) ELSE 0 END AS BIGINT) AS _sure,
                      CAST(CASE WHEN _total > 0 THEN floor({w} * ({s} + _half) / _total + 0.5) + 1 ELSE 0 END AS BIGINT) AS _most FROM a),
      c AS (SELECT *, {s} - CAST(sum(_sure) OVER (PARTITION BY {by}) AS BIGINT) AS _left FROM b),
      d AS (SELECT *, unnest(CASE WHEN _most > _sure THEN range(_sure + 1, _most + 1) ELSE [CAST(-1 AS BIGINT)] END) AS _k FROM c),
      e AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY CASE WHEN _k < 0 THEN -1.0 ELSE {w} / (2 * _k - 1) END DESC, {tie}) AS _p FROM d)
      SELECT {keep}, CAST(_sure + sum(CASE WHEN _p <= _left AND _k > 0 THEN 1 ELSE 0 END) AS BIGINT) AS won FROM e GROUP BY {keep}, _sure)"""


ORACLE = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sr FROM sizes GROUP BY source),
s1 AS (SELECT *, (sr - 1) % 3 + 1 AS weight FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum({MOST} * source_size) OVER (ORDER BY source_size / weight, sr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, sr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest FROM s1),
s3 AS (SELECT *, (total - capped) / rest AS level0 FROM s2),
s4 AS (SELECT *, (SELECT arg_min(level0, struct_pack(a := source_size / weight, b := sr)) FROM s3 WHERE level0 * weight <= {MOST} * source_size) AS level FROM s3),
s5 AS (SELECT 1 AS one, sr, source, source_size, least(CAST({MOST} * source_size AS DOUBLE), level * weight) AS target, CAST(ceil(total / {BLOCK}) AS BIGINT) AS seats FROM s4),
src AS (SELECT sr, source, source_size, target, won AS seats FROM {_seats_sql("s5", "target", "seats", "one", "sr", "sr, source, source_size, target, seats")}),
dealt AS (SELECT d.*, sr, source_size, target, seats, h % CAST(greatest(ceil(source_size / {SHARD_WORDS}), 1) AS BIGINT) AS shard
          FROM sizes d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
c0 AS (SELECT sr, shard, CAST(sum(size) AS BIGINT) AS cell, min(seats) AS seats FROM dealt GROUP BY sr, shard),
cells AS (SELECT sr, shard, cell, least(won * {BLOCK}, {MOST} * cell) AS want FROM {_seats_sql("c0", "cell", "seats", "sr", "shard", "sr, shard, cell, seats")}),
laid AS (SELECT dealt.*, cell, want, CAST(sum(size) OVER (PARTITION BY dealt.sr, dealt.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
         FROM dealt JOIN cells ON dealt.sr = cells.sr AND dealt.shard = cells.shard)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN cell > 0 THEN floor(want / cell) * size ELSE 0 END
            + greatest(0, least(size, want - (CASE WHEN cell > 0 THEN CAST(floor(want / cell) AS BIGINT) ELSE 0 END) * cell - start)) AS BIGINT) AS taken
FROM laid
"""
