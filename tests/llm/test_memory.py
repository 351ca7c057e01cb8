"""Memory held by workers and executors is bounded, whatever the length of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import packed, runtime, toxicity


def test_powers_of_a_text_beyond_the_kept_tables():
    rolling, n = packed.Rolling(5), packed.KEPT_POWERS + 1000
    start = np.array([0, 20, n - 40])
    end, values = start + 9, np.ones(n, np.uint64)
    values[20:29] = values[n - 40 : n - 31] = np.arange(1, 10)
    got = rolling.spans(rolling.prefix(values), start, end)
    assert got[1] == got[2] != got[0]
    assert all(len(t) <= packed.KEPT_POWERS for t in rolling.kept.values())
    small = rolling.spans(rolling.prefix(values[:100]), start[1:2], end[1:2])
    assert small[0] == got[1] and sum(len(t) for t in rolling.kept.values()) <= 256


def test_arrow_batches_are_bounded_by_bytes(spark):
    before = spark.conf.get(runtime._BATCH, None)
    try:
        spark.conf.unset(runtime._BATCH)
        runtime.shared_dir(spark)
        docs = spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text"))
        sizes = [r.b for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"b": pa.array([b.nbytes], pa.int64())}) for b in batches), "b long").collect()]
        assert len(sizes) >= 8 and max(sizes) <= 2 * runtime.ARROW_BYTES
        spark.conf.set(runtime._BATCH, "1000000")
        runtime.shared_dir(spark)
        assert spark.conf.get(runtime._BATCH) == "1000000"
    finally:
        spark.conf.set(runtime._BATCH, before or str(runtime.ARROW_BYTES))


def test_toxicity_products_hold_a_block_of_features():
    rng, width = np.random.default_rng(4), 1 << 10
    size = np.concatenate(([0, 700], rng.integers(0, 800, 6000), [0]))
    column = rng.integers(0, width, size.sum()).astype(np.int32)
    x = toxicity.Sparse(column, size, width)
    w, e, row = rng.random(width), rng.random(len(size)), np.repeat(np.arange(len(size)), size)
    tracemalloc.start()
    times, back = x.times(w), x.back(e)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(times, np.bincount(row, w[column], len(size))) and np.allclose(back, np.bincount(column, e[row], width))
    assert len(column) > 8 * toxicity.BLOCK_CELLS and peak < 8 * len(column)  # not a double a feature
    none = toxicity.Sparse(column[:0], size[:0], width)
    assert len(none.times(w)) == 0 and not none.back(e[:0]).any()


def test_slices_dealt_by_sid_are_not_moved_by_joins(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(7)
    before, limit = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    slices = packed.pack(docs, 9)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before and sum(len(r.ids) // 8 for r in slices.collect()) == 50
    other = slices.select("sid").groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = slices.join(runtime.settle(other), "sid", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == 1 and slices.rdd.getNumPartitions() == 9
