"""Phrase collocations against a plain version, with the awkward cases."""

import random
import re
import weakref
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, word string, ids int"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(25)] + ["É", "ü", "ctl\x01", "ctl", "a'b"]
    sep = [" "] * 30 + ["  ", "\t", ". ", ", ", "\n", "\x0b", "!", ";"]
    rows = []
    for i in range(60):
        text = "".join(rnd.choice(words[: rnd.choice((5, 12, 30))]) + rnd.choice(sep) for _ in range(rnd.randint(0, 150)))
        rows.append((i, text + " Of The Same KIND " * (i % 4), rnd.choice(["en", "fr", None, "und"]), "x", 1))
    rows += [(None, None, "en", "x", 1), (3, "", "de", "x", 1), (3, "...", None, "x", 1), (70, "on and on " * 3000, "en", "x", 1), (70, "on and on " * 3000, "en", "x", 1)]
    return rows


def plain(rows, least, share, most):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        kept = []
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            holds = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and 100 * b >= share * a and holds(q) for q, b in cand.items()):
                kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "bitmap"), [(3, 2000, True), (3, 7, False), (30, 2000, True)])
def test_collocations_match_a_plain_version(spark, monkeypatch, least, most, bitmap):
    if not bitmap:
        monkeypatch.setattr(collocations, "BITMAP_BITS", 0)
        monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    rows = corpus()
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least, most=most)
    want = plain(rows, least, 80, most)
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_slices_and_word_counts_are_let_go_before_phrases(spark, monkeypatch):
    held, seen = [], []

    def kept(f):
        def run(*args):
            out = f(*args)
            held.append(weakref.ref(out))
            return out

        return run

    def frequent(*args, f=collocations.frequent):
        seen.append([x() is None for x in held])
        return f(*args)

    for name in ("slices", "word_counts"):
        monkeypatch.setattr(collocations, name, kept(getattr(collocations, name)))
    monkeypatch.setattr(collocations, "frequent", frequent)
    assert collocations.collocations(spark.createDataFrame(corpus(), SCHEMA), 3).count()
    assert seen == [[True, True]] * 2


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame(corpus(), SCHEMA).limit(0)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 1)], SCHEMA)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 6_000_000_000_000_007
    words = spark.createDataFrame([(1, "en", "x", big), (2, "en", "y", big + 5)], "id long, lang string, word string, f long")
    phrases = spark.createDataFrame([((1 << 32) | 2, 0, big - 11)], "hi long, lo long, f long")
    assert collocations.scored(phrases, words).first().score == 2_000_000 * (big - 11) // (2 * big + 5)


def test_radix_order():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 5, 400).astype(np.uint64) << np.uint64(40), rng.integers(0, 1 << 63, 400).astype(np.uint64)
    assert (collocations.radix_order([hi, lo]) == np.lexsort((lo, hi))).all()
    assert len(collocations.radix_order([hi[:0], lo[:0]])) == 0


def test_keys_travel_packed_and_add_up():
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    import zstandard

    rnd = np.random.default_rng(8)
    ids = rnd.integers(0, 60_000, 1_200_000).astype(np.uint32)
    ids[: len(ids) // 2] = rnd.integers(1, 40, len(ids) // 2)
    ids = [ids, ids[:50_000]]
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([zstandard.compress(x.tobytes()) for x in ids], pa.binary())})
    for sizes in ([2], [3, 4]):
        want = Counter()
        for x in ids:
            for n in sizes:
                want.update(zip(*(k.tolist() for k in collocations._packed(x, n, None)), strict=True))
        sent = pa.Table.from_batches(list(collocations._phrases(sizes, None, 5)(iter([batch]))))
        assert set(sent.column("bucket").to_pylist()) == set(range(5))
        if sizes == [2]:
            assert sum(len(v) for k in ("hi", "lo", "c") for v in sent.column(k).to_pylist()) < 5.5 * len(want)
        got = {}
        for b in range(5):
            t = collocations._counts(2)(sent.filter(pa.compute.equal(sent.column("bucket"), b)))
            got |= {(h & (1 << 64) - 1, low & (1 << 64) - 1): f for h, low, f in zip(*(t.column(k).to_pylist() for k in ("hi", "lo", "f")), strict=True)}
        assert got == {k: f for k, f in want.items() if f >= 2} and got
