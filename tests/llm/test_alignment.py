"""Cross-tokenizer alignment against a plain version that encodes whole texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from ledgerloom.llm import alignment

SCHEMA = "doc_id long, text string, pairs string, sid int"


def corpus():
    rnd = random.Random(2)
    odd = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\u0085", "é", "ß", "“x”", "日本語", "🙂", "é", "́", "'s", "’ll", "1234", "...", "—", "\x00", "\x1c", "<s>", "<|endoftext|>", "﻿", "ﬁ", "-", "_", "a", "The", "ization"]
    words = ["the", "worthless", "Unbelievably", "don't", "naïve", "x=1;", "(foo)", "über", "straße", "end."]
    texts = [None, "", " ", "  two", "a ", "a  b", "x▁y", "▁", "plain words only here", "<unk> <0x0A> </s>", "Ω ≈ ç √"]
    for _ in range(250):
        texts.append("".join(rnd.choice(odd) + rnd.choice(["", " ", "", rnd.choice(words)]) for _ in range(rnd.randint(1, 30))))
    for _ in range(60):
        texts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80))))
    return [*texts, texts[-1], texts[-1], " ".join(rnd.choice(words) for _ in range(30000)), "unbroken" * 2000]


def plain(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(v): v for v in visible} | {chr(256 + i): v for i, v in enumerate(v for v in range(256) if v not in visible)}
    raw = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    parsed, count = [], Counter()
    for t in texts:
        found = None
        if t:
            x = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            y = [(i, raw(b.id_to_piece(i))) for i in b.encode(t)]
            if b"".join(v for _, v in x) == b"".join(v for _, v in y) == (" " + t).encode():
                found = x, y
        links, groups = [], []
        if found:
            (x, y), i, j, ea, eb, now = found, 0, 0, len(found[0][0][1]), len(found[1][0][1]), ([], [])
            now[0].append(x[0][0]), now[1].append(y[0][0])
            while True:
                links.append((x[i][0], y[j][0]))
                if ea == eb:
                    groups.append(now)
                    i, j, now = i + 1, j + 1, ([], [])
                    if i == len(x):
                        break
                    ea, eb = ea + len(x[i][1]), eb + len(y[j][1])
                    now[0].append(x[i][0]), now[1].append(y[j][0])
                elif ea < eb:
                    i += 1
                    ea += len(x[i][1])
                    now[0].append(x[i][0])
                else:
                    j += 1
                    eb += len(y[j][1])
                    now[1].append(y[j][0])
        parsed.append((found, groups, links))
        count.update(links)
    top = {}
    for (_, y), c in count.items():
        top[y] = max(top.get(y, 0), c)
    out = []
    for d, (found, groups, links) in enumerate(parsed):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((d, *(map(len, found) if found else (0, 0)), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return out, [g or None for _, g, _ in parsed]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def test_alignment_matches_a_plain_version(spark, monkeypatch):
    texts = corpus()
    want, groups = plain(texts)
    assert sum(w[1] > 0 for w in want) > 150 and sum(bool(t) and w[1] == 0 for t, w in zip(texts, want, strict=True)) >= 2
    assert sorted(tuple(r) for r in alignment.alignment(table(spark, texts)).collect()) == want
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in alignment.alignment(table(spark, texts)).collect()) == want
    got = {r.doc_id: r.groups and [(list(g.a), list(g.b)) for g in r.groups] for r in alignment.token_groups(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == groups


def test_null_and_repeated_ids_and_empty_tables(spark):
    docs = table(spark, ["one two", "one two", None]).withColumn("doc_id", F.when(F.col("doc_id") == 0, None).otherwise(7))
    got = alignment.alignment(docs).collect()
    assert sorted((r.doc_id is None, r.n_a) for r in got) == [(False, 0), (False, 2), (True, 2)]
    assert {r.count_sum for r in got if r.n_a} == {4}
    assert alignment.alignment(docs.limit(0)).count() == 0


def test_pairs_are_counted_once_for_each_link(spark):
    made = alignment.aligned_slices(table(spark, ["one two", "two one", "one"]))
    counts = alignment.pair_counts(made).collect()
    assert sum(r["count"] for r in counts) == 5 and all(r.best for r in counts)


def test_components():
    rng = np.random.default_rng(4)
    for n in (1, 5, 200):
        left, right = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        least = list(range(n))
        for _ in range(n):
            for x, y in zip(left, right, strict=True):
                least[x] = least[y] = min(least[x], least[y])
        assert alignment.components(n, left, right).tolist() == least


def test_cache_starts_anew_when_full(monkeypatch):
    pair = alignment.Pair(public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE))
    texts = [t.encode() for t in corpus() if t]
    data, lens = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    at = np.concatenate(([0], np.cumsum(lens)))
    once = alignment.Aligner(pair)
    want = [alignment.align_slice(once, at[i : i + 41], data, lens[i : i + 40]) for i in range(0, len(lens), 40)]
    monkeypatch.setattr(alignment, "KEPT_BYTES", 1000)
    small = alignment.Aligner(pair)
    for i, w in zip(range(0, len(lens), 40), want, strict=True):
        got = alignment.align_slice(small, at[i : i + 41], data, lens[i : i + 40])
        assert all(np.array_equal(np.asarray(got[k]), np.asarray(w[k])) for k in w)
