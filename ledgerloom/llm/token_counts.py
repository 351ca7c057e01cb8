"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but little-endian 16- or 32-bit ids, each document closed by the end-of-document id. Files are
cut into blocks of equal size wherever documents lie; each block is searched for the end id in one vectorised
comparison and reports only its lengths between ends, its head (tokens up to its first end) and its tail (tokens after
its last). A prefix scan over the blocks of a file then stitches documents across any number of blocks: the tail of
the last block that had an end, plus the whole blocks since, goes before the next head. Blocks are the only unit of
work, so one very long file or document is many tasks; the scan sees three numbers a block.

Defined cases: an empty file has no documents; tokens after the last end are a document without an end
(``closed`` false); two ends in a row are a document of no tokens; null and empty text is such a document; with a null
doc_id the id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import Encoder, vocabulary_path
from .packed import Slice, batch_slices
from .runtime import fresh_dir, read, settle
from .token_files import put, store

END = 49407  # the vocabulary's own end-of-text id; special strings in texts are ordinary text here, so it cannot occur inside one
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 8 << 20


def _writer(folder: str, vocabulary: str, end: int, file_tokens: int, width: int):
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def run(batches):
        encoder = Encoder(vocabulary, special=False)
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal n, held, size
            name = f"{part:06d}-{n:06d}.u{8 * width}"
            put(f"{folder}/{name}", b"".join(t for _, t in held))
            ids = pa.concat_arrays([i for i, _ in held])
            n, held, size = n + 1, [], 0
            return pa.RecordBatch.from_pydict({"file": pa.array([name] * len(ids), pa.string()), "ordinal": pa.array(np.arange(len(ids)), pa.int64()), "doc_id": ids})

        for batch in batches:
            done = 0
            for ids, lens, buf in batch_slices(batch.column(0), batch.column(1)):
                tokens, sizes = encoder.encode(Slice(ids, lens, buf))
                out = np.insert(tokens, np.cumsum(sizes), end)
                if len(out) and out.max() > np.iinfo(kind).max:
                    raise ValueError("ids of this vocabulary need files of four bytes an id")
                held.append((batch.column(0)[done : done + len(ids)], out.astype(kind).tobytes()))
                done, size = done + len(ids), size + len(out)
                if size >= file_tokens:
                    yield flush()
        if held:
            yield flush()

    return run


def write_flat(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, file_tokens: int = FILE_TOKENS, width: int = 2) -> DataFrame:
    """Write flat files of ``width`` bytes an id; returns which document is which of each file: (file, ordinal, doc_id), written out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(_writer(folder, vocabulary or vocabulary_path(), end, file_tokens, width), "file string, ordinal long, doc_id long"))


def _scan(folder: str, end: int, width: int):
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def run(batches):
        for batch in batches:
            for name, no, begin, count in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                files, path = store(f"{folder}/{name}")
                with files.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(count * width, begin * width), kind)
                at = np.flatnonzero(ids == end)
                inner = np.diff(at) - 1
                head = int(at[0]) if len(at) else len(ids)
                tail = len(ids) - 1 - int(at[-1]) if len(at) else len(ids)
                offsets = pa.array([0, len(inner)], pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([name]), "block": pa.array([no], pa.int64()), "ends": pa.array([len(at)], pa.int64()),
                    "head": pa.array([head], pa.int64()), "tail": pa.array([tail], pa.int64()),
                    "inner": pa.ListArray.from_arrays(offsets, pa.array(inner, pa.int64())),
                })

    return run


def count_tokens(spark, folder: str, end: int = END, width: int = 2, block_tokens: int = BLOCK_TOKENS, pattern: str = "*.u16") -> DataFrame:
    """A row a document of the flat files of ``folder``: file, ordinal (from 0), n_tokens (without the end), closed."""
    sizes = spark.read.format("binaryFile").load(f"{folder}/{pattern}").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.floor(F.col("length") / width).alias("n"))
    blocks = sizes.where("n > 0").select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block_tokens))).alias("block"), "n")
    blocks = blocks.select("file", "block", (F.col("block") * block_tokens).alias("begin"), F.least(F.lit(block_tokens), F.col("n") - F.col("block") * block_tokens).alias("count"))
    found = settle(blocks.repartition("file", "block").mapInArrow(_scan(folder, end, width), "file string, block long, ends long, head long, tail long, inner array<long>"))

    # documents that end in earlier blocks, and tokens since the last end: all tails since that end, block by block
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("file", "block", "ends", "head", "tail", F.max("block").over(Window.partitionBy("file")).alias("last"))
    scan = scan.withColumn("ordinal", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    scan = scan.withColumn("run", F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("block"))).over(before), F.lit(-1)))
    scan = scan.withColumn("tails", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    # sum of tails up to the block before the one with the last end is constant in a run
    base = F.min("tails").over(Window.partitionBy("file", "run"))
    opened = F.when(F.col("run") < 0, F.lit(0)).otherwise(F.first("tail_at").over(Window.partitionBy("file", "run").orderBy("block")))
    scan = scan.withColumn("tail_at", F.lag("tail").over(order)).withColumn("carry", F.col("tails") - base + opened)
    joint = scan.where("ends > 0").select("file", "ordinal", (F.col("carry") + F.col("head")).alias("n_tokens"), F.lit(True).alias("closed"))
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    open_ = scan.where("block = last").select("file", (F.col("ordinal") + F.col("ends")).alias("ordinal"), left.alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    whole = found.where(F.size("inner") > 0).join(scan.select("file", "block", "ordinal"), ["file", "block"])
    whole = whole.select("file", "ordinal", F.posexplode("inner").alias("p", "n_tokens")).select("file", (F.col("ordinal") + F.col("p") + 1).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    return joint.unionByName(open_).unionByName(whole)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "flat")
    owners = write_flat(read(spark, sf_dir, "documents"), folder)
    if owners.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    return count_tokens(spark, folder).join(owners, ["file", "ordinal"]).select("doc_id", "n_tokens")
