"""The pipeline against plain Python, its stages on their own inputs, and the registry."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
import __spark_entry__
from ledgerloom.llm import encoding, source_mixing


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        was = docs.count()
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if i < 4:
            assert docs.columns == names
        if i < 3:
            assert 0.5 * was < docs.count() <= was
        if i == 3:
            mixed = docs.groupBy("doc_id").count().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "source_mixing", "token_files"]
    assert docs.select("doc_id").distinct().count() == mixed


def test_every_operator_has_a_query():
    names = set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert __spark_entry__.oracle_sql()["op9_source_mixing"] == source_mixing.ORACLE


def test_mixing_equals_its_sql(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.sql(source_mixing.ORACLE).fetchall())
    assert sorted(map(tuple, source_mixing.op9_source_mixing(spark, sf).collect())) == want


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture():
    rnd = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdklm" for b in "aeo" for c in "nrst"]
    new = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [new(20), new(12)]
    texts = [None, "12 34", "", "een twee", "ÉTÉ"]
    for _ in range(8):
        base = new(rnd.randint(20, 70))
        near = list(base)
        near[3] = "other"
        texts += [" ".join(base), " ".join(near), " ".join(base)]
    texts += [" ".join(new(9) + items[0] + new(4)), " ".join(items[1]).upper(), " ".join(items[0][:-1]), " ".join(new(6) + items[0][:5])]
    rows = [(i, t, rnd.choice(["aa", "bb", None]), rnd.choice(["north", "south", "south", None])) for i, t in enumerate(texts)]
    return rows, [(i, " ".join(w)) for i, w in enumerate(items)]


def after_language(rows):
    return [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]


def after_near_duplicates(rows):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, head = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    head[i] = head[j] = min(head[i], head[j])
    return [r for i, r in enumerate(rows) if head[i] == i]


def after_decontamination(rows, items):
    norm = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cosine = lambda a, b: sum(n * b[g] for g, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if a and b else 0

    def leaks(t):
        w = norm(t)
        for _, item in items:
            x = norm(item)
            windows = [w[i : i + len(x)] for i in range(len(w) - len(x) + 1)] or [w]
            if any(cosine(grams(v), grams(x)) >= 0.8 for v in windows):
                return True
        return False

    return [r for r in rows if not leaks(r[1])]


def after_mixing(rows):
    import duckdb
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    taken = {d: (size, got) for d, size, _, _, got in duckdb.connect().execute(source_mixing.ORACLE).fetchall()}
    out = []
    for r in rows:
        size, got = taken[r[0]]
        out += [r] * int(got / size + 0.5) if size and got else []
    return out


def test_pipeline_matches_plain_python(spark, tmp_path):
    rows, items = fixture()
    sf = tmp_path.as_uri()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    left = [after_language(rows)]
    left.append(after_near_duplicates(left[-1]))
    left.append(after_decontamination(left[-1], items))
    left.append(after_mixing(left[-1]))
    assert len(rows) > len(left[0]) > len(left[1]) > len(left[2]) and Counter(r[0] for r in left[3]).most_common(1)[0][1] > 1
    library, start, want = encoding.Encoder(encoding.vocabulary_path()).library, 0, []
    for d, text, *_ in sorted(left[3]):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(want)


def test_stages_with_awkward_rows_and_columns(spark, sf):
    rows = [(None, None), (1, ""), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "some other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "1L AS n_chars", "5 AS _own", "6 AS key", "7 AS _c", "8 AS sid", "9 AS size", "10 AS component")
    kept = {"language_id": 4, "ngram_jaccard_join": 4, "decontamination": 6, "source_mixing": 6}  # two blocks of 16 words are taken of 22 words in four rows
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == kept[name], name
        assert {tuple(r)[5:] for r in out.collect()} == {(5, 6, 7, 8, 9, 10)}
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() == 6
