"""Operators against brute force on small tables with the awkward cases: nulls, empty and long texts, repeats, ties, extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, decontamination, encoding, jaccard_join, language_id, line_dedup, source_mixing, substring_dedup, token_counts, token_files, toxicity, vector_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid int, bucket string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None, sources=None, langs=None):
    n = len(texts)
    rows = [((ids or range(n))[i], texts[i], (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], len(texts[i] or ""), 7, "clash") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pa_batch(row):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist([row])


def pa_table(columns, bag):
    import pyarrow as pa

    return pa.table({c: pa.array(v) for c, v in columns.items()} | {"bag": bag})


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["é", "Ü", "x,", "1.5"]
    new = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = [new(60) for _ in range(6)]
    passage = new(55)
    texts = [None, "", " \t\n ", "one", "one two", "ONE two", "one two three", new(3000)]
    texts += base + [base[0], base[0].upper(), base[1] + " tail", base[2].replace("w1", "w2", 1), "\n".join(base[3].split())]
    texts += [new(30) + " " + passage + " " + new(9), passage, new(4) + "\n" + passage, "same " * 90, "same " * 45]
    return texts


TEXTS = corpus()


def test_substring_dedup_matches_brute_force(spark):
    seen, want = set(), {}
    for d, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(tuple(w[i : i + 20]))
        want[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(table(spark, TEXTS)).collect()}
    assert {d: (r.n_words, r.n_removed, r.kept_text) for d, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 200
    for r in got.values():
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_substring_dedup_null_and_repeated_ids(spark):
    t = " ".join(f"a{i}" for i in range(25))
    got = substring_dedup.remove_repeats(table(spark, [t, t, t], ids=[None, 5, 5])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 25), (True, 25)]
    assert substring_dedup.remove_repeats(table(spark, [t]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(table(spark, [t]), min_words=10, block=10)


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def joined(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    return {d: (len(sets[d]), least[d]) for d in range(len(texts))}


def near_copies():
    rnd = random.Random(9)
    base = [f"v{i}" for i in range(70)]
    out = []
    for _ in range(40):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(70)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    chain = [f"c{i}" for i in range(60)]
    for i in range(12):
        out.append(" ".join(chain[i : i + 44]))
    return out


@pytest.mark.parametrize(("k", "t", "num", "den"), [(4, 0.85, 17, 20), (5, 0.8, 4, 5)])
def test_jaccard_components_match_brute_force(spark, k, t, num, den):
    texts = TEXTS + near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table(spark, texts), k, t).collect()}
    assert got == joined(texts, k, num, den)


def test_jaccard_links_inside_a_group_and_beyond_its_head(spark):
    head = [f"p{i}" for i in range(20)]
    tail = lambda c, n=20: [f"{c}{i}" for i in range(n)]
    texts = [head + tail("x"), head + tail("y"), head + tail("y", 19) + ["v"]]
    texts += [[f"f{i}"] + tail(c) + (["v"] if c == "y" else []) for i in range(8) for c in "xyz"]
    texts = [" ".join(t) for t in texts]
    for k, t, num, den in ((1, 0.9, 9, 10), (1, 0.85, 17, 20), (4, 0.8, 4, 5)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table(spark, texts), k, t).collect()}
        assert got == joined(texts, k, num, den)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_on_shared_rare_prefixes_and_frequent_tails(spark, seed):
    rnd = random.Random(seed)
    tails = [[f"t{j}_{i}" for i in range(24)] for j in range(4)]
    heads = [[f"h{j}_{i}" for i in range(10)] for j in range(3)]
    texts = []
    for _ in range(90):
        w = rnd.choice(heads) + rnd.choice(tails)
        for _ in range(rnd.choice((0, 0, 1, 3, 6))):
            w[rnd.randrange(10, len(w))] = f"t{rnd.randrange(4)}_{rnd.randrange(30)}"
        texts.append(" ".join(dict.fromkeys(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table(spark, texts), 1, 0.85).collect()}
    assert got == joined(texts, 1, 17, 20)
    stays = {r.doc_id for r in jaccard_join.one_of_each(table(spark, texts), 1, 0.85).collect()}
    assert stays == {c for _, c in joined(texts, 1, 17, 20).values()}


def test_one_of_each_keeps_clashing_columns(spark):
    t = "a b c d e f g h i j"
    docs = table(spark, [t, t, "x y"]).selectExpr("*", "'mine' AS _own", "doc_id AS _other", "1 AS _OWN_")
    got = sorted((r.doc_id, r._own, r._other) for r in jaccard_join.one_of_each(docs).collect())
    assert got == [(0, "mine", 0), (2, "mine", 2)] and jaccard_join.one_of_each(docs).columns == docs.columns


def test_jaccard_null_repeated_and_empty(spark):
    t = "a b c d e f g"
    got = jaccard_join.jaccard_components(table(spark, [t, t, "x", None], ids=[None, 4, 4, 2])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 3, 4), (2, 0, 2), (4, 1, 4), (4, 3, 4)]
    assert jaccard_join.jaccard_components(table(spark, [t]).limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    t, u = "a b c d e f g h i j", "q r s t u v w x y z"
    docs = table(spark, [t, t, t, u, u, None, None, ""], ids=[9, 3, 3, 5, None, 1, 1, 2])
    got = sorted((r.doc_id, r.text or "") for r in jaccard_join.one_of_each(docs).collect())
    assert got == [(1, ""), (1, ""), (2, ""), (3, t), (5, u)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals of the wood"
    near = long.replace("lazy", "tired")
    texts = [long + "\nAlpha 12", "alpha 99!\n\n" + long.upper() + ".\nkeep", None, "", "\n", near, "alpha 12 x"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.remove_repeated_lines(table(spark, texts)).collect()}
    assert got[0] == (2, 0, texts[0])
    assert got[1] == (4, 2, "\nkeep")
    assert got[2] == (0, 0, None) and got[3] == (1, 0, "") and got[4] == (2, 0, "\n")
    assert got[6] == (1, 0, "alpha 12 x")
    assert line_dedup.remove_repeated_lines(table(spark, texts).limit(0)).count() == 0


def plain(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_edit_distance():
    rnd = np.random.default_rng(0)
    for _ in range(300):
        a, b = (rnd.integers(0, 4, rnd.integers(0, 30)) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain(a.tolist(), b.tolist())


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rnd.randrange(len(words))
        kind = rnd.choice("rrid")
        words[i : i + (kind != "i")] = [] if kind == "d" and len(words) > 1 else [f"w{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}"]
    return words


def kept_lines(texts, threshold):
    """What is left of texts with lines of words: components of edit similarity alone, by all pairs."""
    places = [(d, i, tuple(line.split())) for d, t in enumerate(texts) for i, line in enumerate(t.split("\n"))]
    nodes = sorted({w for *_, w in places if w})
    root = {w: w for w in nodes}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for a, b in itertools.combinations(nodes, 2):
        n = max(len(a), len(b))
        if abs(len(a) - len(b)) <= (1 - threshold) * n + 1e-9 and plain(a, b) <= (1 - threshold) * n + 1e-9:
            root[find(a)] = find(b)
    seen, out = set(), [[] for _ in texts]
    for d, _, w in places:
        if not w or find(w) not in seen:
            out[d].append(" ".join(w))
        if w:
            seen.add(find(w))
    return ["\n".join(x) for x in out]


def test_near_lines_of_each_length_are_found(spark):
    """Recall against edit similarity alone, for lines that differ by as much as is allowed, among unrelated ones of the same words."""
    rnd = random.Random(5)
    vocabulary = ["the", "of", "and", "to", "in"] * 12 + [f"q{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    pairs, lines = {}, []
    for n in (5, 7, 10, 15, 20, 30, 50, 100):
        for _ in range(25):
            base = [rnd.choice(vocabulary) for _ in range(n)]
            near = edited(rnd, base, max(1, n // 5))
            if plain(base, near) <= int(0.2 * max(len(base), len(near)) + 1e-9):
                pairs.setdefault(n, []).append((len(lines), len(lines) + 1))
                lines += [base, near]
            lines.append([rnd.choice(vocabulary) for _ in range(n)])
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_repeated_lines(table(spark, [" ".join(w) for w in lines])).collect()}
    for n, some in pairs.items():
        assert len(some) > 10 and sum(got[b] for _, b in some) >= 0.98 * len(some), n
    partners = {b for some in pairs.values() for _, b in some}
    assert sum(g for d, g in got.items() if d not in partners) <= 2


def test_line_dedup_null_and_repeated_ids_and_long_lines(spark):
    a, long = "one two three four five six", " ".join(f"z{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(12000))
    other = long.replace("zaab ", "", 1) + " end"
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, len(r.kept_text)) for r in line_dedup.remove_repeated_lines(table(spark, [a, a, a, long, other], ids=[None, 4, 4, 8, 9])).collect())
    assert got == [(False, 4, 0, len(a)), (False, 4, 1, 0), (False, 8, 0, len(long)), (False, 9, 1, 0), (True, 0, 1, 0)]


def test_large_families_of_lines_give_few_pairs():
    import pyarrow as pa

    rnd, n = np.random.default_rng(0), 600
    t = pa.table({c: pa.array(v) for c, v in {"tok": np.zeros(n, np.int64), "node": rnd.permutation(n), "n": np.full(n, 40, np.int32), "print": np.zeros(n, np.int64), "low": np.zeros(n, np.int64), "high": np.zeros(n, np.int64), "chunk": np.zeros(n, np.int64), "cell": np.zeros(n, np.int64), "across": np.zeros(n, bool), "component": rnd.permutation(n) % 3}.items()})
    assert line_dedup._compare(0.8, 24, False)(t).num_rows == n - 1
    assert line_dedup._compare(0.8, 24, True)(t).num_rows == 3 * (n // 3) ** 2  # across components only


def test_line_histograms_tell_long_lines_apart():
    """Lines of 80 words that differ in 20 pass a filter of few counts; those that differ in 16 are near."""
    import zstandard

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(80)]
    lines = [base, [w if i % 5 else word() for i, w in enumerate(base)]] + [[w if i % 4 else word() for i, w in enumerate(base)] for _ in range(30)]
    buf = ("\n".join(" ".join(w) for w in lines) + "\n").encode()
    row = {"sid": 0, "ids": np.zeros(1, np.int64).tobytes(), "lens": np.array([len(buf) - 1], np.int32).tobytes(), "body": zstandard.compress(buf), "want": list(range(len(lines))), "df": None}
    found = next(line_dedup._post(1, 0.8)(iter([pa_batch(row | {"df": [{"bucket": 0, "reply": bytes([6]) * 78 * len(lines)}]})])))
    n = len(lines)
    bags = {b.as_py(): i for i, b in enumerate(found.column("bag"))}
    assert len(bags) == n and {len(b) for b in bags} == {line_dedup.BINS // 2}
    t = {c: np.zeros(n, np.int64) for c in ("tok", "prev", "print", "chunk", "cell")} | {"node": np.arange(n), "component": np.arange(n), "n": np.full(n, 80, np.int32), "across": np.zeros(n, bool)}
    pairs = line_dedup._compare(0.8, 64, True)(pa_table(t, found.column("bag")))
    first = [(u, v) for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist()) if u == 0]
    assert (0, 1) in first and len(first) <= 10  # with 32 counts all 31 pass


def test_lists_within_others_are_not_read_again(spark):
    """Round two reads a list whose lines all post the same block before it only through that block's list."""
    rows = [(node, node * 10, [(1, 0, 6, True), (2, 1, 6, True), (3, 2 + node % 2, 6, True)]) for node in range(4)]
    found = spark.createDataFrame(rows, "node long, n int, posts array<struct<tok:long,prev:long,code:int,few:boolean>>")
    for part, toks in ((None, [1, 3]), ([(1, 0), (2, 0), (3, 0)], [])):
        part = None if part is None else spark.createDataFrame(part, "node long, component long")
        got = line_dedup._across(found, found.select("node", "n"), part).collect()
        assert sorted((r.tok, r.node) for r in got) == [(t, node) for t in toks for node in range(4)]


def test_line_dedup_without_leaders_pairs(spark, monkeypatch):
    """Links that no leader finds are found across components."""
    monkeypatch.setattr(line_dedup, "LEADERS", 0)
    base = [f"w{chr(97 + i)}" for i in range(12)]
    texts = [" ".join(base), " ".join([*base[:5], "x", *base[6:]])]
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_repeated_lines(table(spark, texts)).collect()}
    assert got == {0: 0, 1: 1}


def slice_row(lines, **more):
    import zstandard

    buf = ("\n".join(lines) + "\n").encode()
    return {"sid": 0, "ids": np.zeros(1, np.int64).tobytes(), "lens": np.array([len(buf) - 1], np.int32).tobytes(), "body": zstandard.compress(buf)} | more


def test_near_lines_with_distant_fingerprints_are_found(spark):
    """A word that stands twenty times in a hundred is another, so that about half of the fingerprints' bits may differ."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    lines = []
    for _ in range(60):
        base, x, y = [word() for _ in range(80)], word(), word()
        lines += [" ".join(w for i in range(20) for w in (*base[4 * i : 4 * i + 4], z)) for z in (x, y)]
    x = line_dedup.Lines(slice_row(lines)).hashed()
    bits = x.prints(x.numbers())
    apart = np.bitwise_count(bits[::2] ^ bits[1::2])
    far = np.flatnonzero(apart > 24).tolist()
    assert len(far) > 3 and apart.max() > 32
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_repeated_lines(table(spark, [lines[2 * i + j] for i in far for j in (0, 1)])).collect()}
    assert [got[i] for i in range(2 * len(far))] == [0, 1] * len(far)


def test_word_hashes_of_every_length():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("ab") for _ in range(n)) for n in range(1, 200) for _ in range(2)]
    hashes = [dict(zip(order, line_dedup.Lines(slice_row([" " * k + " ".join(order)])).hashed().hash.tolist(), strict=True)) for k in range(8) for order in [rnd.sample(list(dict.fromkeys(words)), len(set(words)))]]
    assert all(h == hashes[0] for h in hashes) and len(set(hashes[0].values())) == len(set(words))


def test_similar_pairs_match_the_edit_distance():
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    pairs = []
    for _ in range(600):
        a = rnd.integers(0, 30, rnd.integers(0, 25)).tolist()
        b = list(a)
        for _ in range(rnd.integers(0, 7)):
            i = rnd.integers(0, len(b) + 1)
            b[i : i + rnd.integers(0, 2)] = rnd.integers(0, 30, rnd.integers(0, 2)).tolist()
        pairs.append((a, b))
    pairs += [(a, b[::-1]) for a, b in pairs[:50]]
    column = lambda k: pa.array([np.array(p[k], np.uint32).tobytes() for p in pairs], pa.binary())
    want = [plain(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    assert line_dedup.similar(column(0), column(1), 0.8).tolist() == want and 100 < sum(want) < 500
    assert line_dedup.similar(column(0).slice(7), column(1).slice(7), 0.8).tolist() == want[7:]
    assert line_dedup.similar(column(0)[:0], column(1)[:0], 0.8).tolist() == []


def test_equal_lines_and_lists_travel_packed():
    """A slice sends a line once, however often it has it, and a batch of lines a list twice at most."""
    import pyarrow as pa

    lines = ["a b c d e"] * 500 + ["x y"] * 3 + [""]
    (sent,) = line_dedup._occurrences(1, 4)(iter([pa_batch(slice_row(lines))]))
    assert sum(len(x.as_py()) for x in sent.column("key")) == 2 * 8
    got = line_dedup._firsts(pa.Table.from_batches([sent])).to_pylist()
    assert [(r["want"], sorted(r["later"])) for r in got] == [([0], [*range(1, 500), 501, 502])]
    part = {"lines": line_dedup.zstandard.compress(ipc(pa.RecordBatch.from_pydict({"node": np.arange(300), "component": np.arange(300) % 7})))}
    posts = np.concatenate((np.full(300, 5), np.zeros(300, np.int64))).astype(np.int64).tobytes() + bytes(300)
    held = line_dedup.Held(part | {"count": np.ones(300, np.int32).tobytes(), "posts": line_dedup.zstandard.compress(posts)})
    assert [v.tolist() for v in held.entry] == [[5, 5], [0, 6], [0, 0]]


def ipc(batch):
    import pyarrow as pa

    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as to:
        to.write_batch(batch)
    return out.getvalue().to_pybytes()


@pytest.mark.parametrize("threshold", [0.8, 0.7])
def test_line_dedup_matches_brute_force_on_edit_similarity(spark, threshold):
    rnd = random.Random(11)
    vocabulary = [f"v{chr(97 + i)}" for i in range(26)] + [f"v{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    lines = []
    for n in [*range(1, 41), 60, 120]:
        base = [rnd.choice(vocabulary) for _ in range(n)]
        lines.append(base)
        for share in (0.02, 0.1, 0.19, 0.22):  # on both sides of the threshold
            lines.append(edited(rnd, base, max(1, int(share * n + 0.5))))
        lines.append(edited(rnd, lines[-2], n // 5))  # a chain
    lines += [[rnd.choice("abc") for _ in range(rnd.randint(3, 9))] for _ in range(60)]
    rnd.shuffle(lines)
    texts = ["\n".join(" ".join(w) for w in lines[i : i + 9]) for i in range(0, len(lines), 9)]
    want = kept_lines(texts, threshold)
    got = {r.doc_id: r.kept_text for r in line_dedup.remove_repeated_lines(table(spark, texts), threshold=threshold).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(t.count("\n") for t in want) < sum(t.count("\n") for t in texts) - 60


def test_decontamination_matches_brute_force(spark):
    norm = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    rnd = random.Random(4)
    new = lambda n: [f"t{rnd.randrange(500)}" for _ in range(n)]
    items = [new(30), new(14), ["Été,"] + new(20), ["two", "words"], new(25)]
    edited = list(items[0])
    edited[3] = "changed"
    texts = [None, "", " ".join(new(50) + items[0] + new(9)), "; ".join(w.upper() for w in items[2]), " ".join(new(5) + edited), " ".join(items[1][:-6]), "it has TWO words", " ".join(new(2000))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, " ... ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_leaks(table(spark, texts), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        w = norm(t or "")
        for i, item in enumerate(items):
            x = norm(" ".join(item))
            k = min(5, len(x))
            sh = lambda v, k=k: Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            c = sh(x)
            best = 0
            for j in range(len(w) - len(x) + 1):
                y = sh(w[j : j + len(x)])
                best = max(best, sum(n * c[g] for g, n in y.items()) / math.sqrt(sum(n * n for n in y.values()) * sum(n * n for n in c.values())))
            if best >= 0.8:
                want[d, i] = best
    assert set(got) == set(want) == {(2, 0), (3, 2), (4, 0), (6, 3)}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    kept = decontamination.clean_documents(table(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 5, 7] and kept.columns == table(spark, texts).columns
    assert decontamination.find_leaks(table(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_finds_shortened_items(spark):
    rnd = random.Random(8)
    words = [f"u{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    item = rnd.sample(words, 59)
    texts = [" ".join(w) for w in (item[:-1], item[3:], item[:30] + item[31:], item[:20], rnd.sample(words, 40))] + ["alone"]
    items = spark.createDataFrame([(7, " ".join(item)), (8, "gone")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.find_leaks(table(spark, texts), items).collect()}
    assert sorted(got) == [0, 1, 2]
    for d, w in enumerate((item[:-1], item[3:], item[:30] + item[31:])):
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, item))
        assert got[d].similarity == pytest.approx(len(a & b) / math.sqrt(len(a) * len(b))) and (got[d].start, got[d].n_words) == (0, len(w))
    left = decontamination.clean_documents(table(spark, texts), items)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5]


def test_decontamination_repeats_nulls_and_long_items(spark):
    import resource

    rnd = random.Random(3)
    item, huge = [f"t{rnd.randrange(900)}" for _ in range(25)], [f"h{i}" for i in range(20000)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (None, "alone here"), (5, " ".join(huge))], "item_id long, text string")
    docs = table(spark, [" ".join(item), " ".join(item), "alone here", " ".join(["x"] * 30 + huge)], ids=[None, 3, 3, 4])
    got = Counter((r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect())
    assert got == {(None, 1): 2, (3, 1): 2, (3, None): 1, (4, 5): 1}
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0 and decontamination.clean_documents(docs, bench).count() == 0
    index = decontamination.ItemIndex([(5, " ".join(huge))])
    import pyarrow as pa

    from ledgerloom.llm.packed import batch_slices

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for ids, lens, buf in batch_slices(pa.array([0]), pa.array([" ".join(["x"] * 20000 + huge + ["x"] * 20000)])):
        assert [(x[2], x[3]) for x in index.search(decontamination._folded(ids, lens, buf), 0.8)] == [(20000, 20000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10


def test_rolling_simhash_equals_simhash():
    h = np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64)
    start = np.array([0, 1, 5, 6, 200, 390])
    assert (decontamination.rolling_simhash(h, start, 9) == decontamination.simhash(h[start[:, None] + np.arange(9)])).all()


def test_multi_index_finds_all_within_radius():
    rnd = np.random.default_rng(2)
    items = [(i, " ".join(f"z{rnd.integers(300)}" for _ in range(20))) for i in range(30)]
    index = decontamination.ItemIndex(items)
    near = rnd.integers(0, 30, 400)
    prints = index.prints[near].copy()
    for t in range(400):
        for b in rnd.choice(512, int(rnd.integers(100, 150)) if t % 2 else 131, replace=False):
            prints[t, b // 64] ^= np.uint64(1 << int(b % 64))
    apart = np.bitwise_count(prints[:, None, :] ^ index.prints[None, :, :]).sum(axis=2)
    want = {(t, i, int(apart[t, i])) for t, i in zip(*np.nonzero(apart <= 131), strict=True)}
    assert set(index.candidates(20, prints)) == want and {(t, near[t]) for t in range(0, 400, 2)} <= {(t, i) for t, i, _ in want}
    with pytest.raises(ValueError):
        decontamination.ItemIndex(items, radius=300)


@pytest.mark.parametrize("n", [14, 20, 59, 300])
def test_multi_index_selects(n):
    """The blocks alone leave under 1 % of items to an unrelated window, and nearly all windows of similarity 0.8 to their item."""
    rnd = np.random.default_rng(n)
    shingles = rnd.integers(0, 1 << 63, (400, n - 4)).astype(np.uint64)
    items = [(i, " ".join(f"y{i}x{j}" for j in range(n))) for i in range(400)]
    index = decontamination.ItemIndex(items)
    t, _ = index.voted(n, decontamination.simhash(shingles))
    assert len(t) < 0.01 * 400 * 400
    w = n - 4
    shared = -(-w * 4 // 5)
    windows = shingles.copy()
    for m in range(400):
        row = index.rows[m]
        windows[m, :shared] = rnd.choice(row, shared, replace=False)
    found = {(t, m) for t, m, _ in index.candidates(n, decontamination.simhash(windows))}
    similar = [m for m in range(400) if index.cosine(m, windows[m]) >= 0.8 - 1e-12]
    assert len(similar) == 400 and sum((m, m) in found for m in similar) >= 0.99 * 400


def test_short_documents_meet_items_by_their_shingles(spark):
    """Documents shorter than an item, against the exact cosine of all pairs: repeated shingles, many items of a size."""
    rnd = random.Random(12)
    words = lambda n: [f"s{rnd.randrange(40)}" for _ in range(n)]
    items = [words(24) for _ in range(40)] + [["a", "b"] * 12]
    texts = [" ".join(x[rnd.randrange(3) : 24 - rnd.randrange(4)]) for x in items] + [" ".join(["a", "b"] * n) for n in (3, 8, 11)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_leaks(table(spark, texts), bench).collect()}
    bag = lambda x: Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4))
    norm = lambda c: math.sqrt(sum(v * v for v in c.values()))
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            a, b = bag(t.split()), bag(x)
            c = sum(v * b[g] for g, v in a.items()) / (norm(a) * norm(b))
            if c >= 0.8 - 1e-12:
                want[d, i] = c
    assert got == pytest.approx(want) and {(len(items) + 1, 40), (len(items) + 2, 40)} <= set(want)


@pytest.fixture(scope="module")
def library():
    return encoding.Encoder(encoding.vocabulary_path()).library


def test_encoder_equals_library(library):
    import pyarrow as pa

    from ledgerloom.llm.packed import Slice, batch_slices

    rnd = random.Random(5)
    parts = list("aAbZé'Éß .,!s't<|>09#\n\t́ …-ñΣς中İ\x1c\x00") + ["'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "½", " the ", "don't"]
    for special in (True, False):
        e = encoding.Encoder(encoding.vocabulary_path(), special)
        for turn in range(60):
            texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(15)]
            if turn % 2:
                texts = [t.replace("<|", "") for t in texts]
            for ids, lens, buf in batch_slices(pa.array(range(15), pa.int64()), pa.array(texts)):
                flat, n = e.encode(Slice(ids, lens, buf))
                got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
                assert got == [e.library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("high", [1, 2, 50, 50000, 1 << 32])
def test_block_round_trip(high):
    rnd = np.random.default_rng(high)
    for n in (0, 1, 255, 256, 257, 3000):
        x = rnd.integers(0, high, n).astype(np.uint32)
        x[rnd.random(n) < 0.03] = high - 1
        for percentile in (50.0, 98.0, 100.0):
            index, area = token_files.pack_blocks(x, percentile)
            assert (token_files.unpack_blocks(index, np.frombuffer(area, np.uint8), n) == x).all()
            if n > 600:  # a block alone
                part = token_files.unpack_blocks(index[1:3], np.frombuffer(area, np.uint8)[int(index[1]) : int(index[2])], 256)
                assert (part == x[256:512]).all()


def test_token_files(spark, library):
    texts = TEXTS + ["## # hash", "a <|endoftext|> b"]
    got = token_files.token_table(table(spark, texts)).orderBy("doc_id").collect()
    start = 0
    for d, (t, r) in enumerate(zip(texts, got, strict=True)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    again = token_files.token_table(table(spark, ["b", "a", None], ids=[4, 4, None])).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in again] == [(None, 0), (4, 1), (4, 3)]
    assert token_files.token_table(table(spark, ["a"]).limit(0)).count() == 0


def test_token_counts(spark):
    lib = encoding.Encoder(encoding.vocabulary_path(), special=False).library
    from ledgerloom.llm.runtime import fresh_dir

    texts = TEXTS + ["a <|endoftext|> b"]
    folder = fresh_dir(spark, "flat")
    owners = token_counts.write_flat(table(spark, texts), folder)
    got = token_counts.count_tokens(spark, folder, block_tokens=64).join(owners, ["file", "ordinal"]).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {d: len(lib.encode(t or "", add_special_tokens=False).ids) for d, t in enumerate(texts)}
    assert len(got) == len(texts) and all(r.closed for r in got)


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_separator_scan_stitches_blocks(spark, block):
    from ledgerloom.llm.runtime import fresh_dir

    rnd, folder, want = np.random.default_rng(0), fresh_dir(spark, "scan"), {}
    for k in range(6):
        x = rnd.integers(0, 9 if k % 2 else 40, int(rnd.integers(0, 60))).astype("<u2")
        token_files.put(f"{folder}/{k}.u16", x.tobytes())
        sizes, n = [], 0
        for v in x:
            n += 1
            if v == 7:
                sizes.append((n - 1, True))
                n = 0
        for i, s in enumerate(sizes + ([(n, False)] if n else [])):
            want[f"{k}.u16", i] = s
    got = token_counts.count_tokens(spark, folder, end=7, block_tokens=block).collect()
    assert {(r.file, r.ordinal): (r.n_tokens, r.closed) for r in got} == want


def languages():
    rnd = random.Random(8)
    parts = {"aa": ["tha", "ing", "wo", "sh"], "bb": ["ción", "ñe", "lla", "os"], "cc": ["ßer", "ung", "schö", "en"]}
    texts, langs = [], []
    for i in range(120):
        lang = "abc"[i % 3] * 2
        langs.append(lang)
        texts.append(" ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(rnd.randint(3, 60))))
    return texts, langs


def test_language_id_learns_and_rejects(spark):
    texts, langs = languages()
    texts += [None, "", "12 34 !!", "中文"]
    langs += ["aa", None, "bb", None]
    docs = table(spark, texts, langs=langs)
    model = language_id.fit(docs, language_id.remainder("doc_id", 5) != 0)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [d for d in range(120) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 10 and sum(got[d].lang_pred == langs[d] for d in held) >= 0.95 * len(held)
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (120, 121, 122)) and got[123].lang_pred in set("abc"[i] * 2 for i in range(3))
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(120), 123]
    nothing = language_id.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def grams_of(text, sizes):
    """Distinct character n-grams of a text, in plain Python."""
    t = "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in (text or "").lower())
    return {t[i : i + n] for n in sizes for i in range(len(t) - n + 1)}


def test_kernels_and_ridge_match_brute_force(spark):
    texts, langs = languages()
    texts[5], texts[6] = "Größe ПРИВЕТ мир", "中文 字 İstanbul " * 3
    docs = table(spark, texts, langs=langs)
    landmarks, k, is_mark, y = language_id.training_rows(docs, F.lit(True), count=30)
    assert is_mark.sum() == 30 and sorted(y) == sorted(langs)
    mark_sets = [set(np.flatnonzero(landmarks.member[:, i])) for i in range(30)]
    assert landmarks.member.shape[1] == 30 and all(mark_sets)
    # kernel values: by sets of characters
    import pyarrow as pa

    from ledgerloom.llm.grams import Folded
    from ledgerloom.llm.packed import batch_slices

    plain_sets = [grams_of(t, (1, 2, 3)) for t in texts]
    want = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in plain_sets] for a in plain_sets])
    (piece,) = batch_slices(pa.array(range(len(texts))), pa.array(texts))
    s = Folded(piece[1], piece[2])
    codes = s.codes((1, 2, 3))
    sets = [np.unique(s.of(codes, d)) for d in range(len(texts))]
    assert [len(x) for x in sets] == [len(x) for x in plain_sets]
    got = np.concatenate([x for _, x in language_id.Landmarks(sets).kernels(s)])
    assert np.allclose(got, want, atol=1e-5)
    # ridge: the regularised least squares in the Nyström space, solved anew
    marks = np.arange(0, 120, 4)
    model = language_id.Model(language_id.Landmarks([sets[i] for i in marks]), want[:, marks].astype(np.float32), np.isin(np.arange(120), marks), langs, ridge=1e-2)
    value, vector = np.linalg.eigh(want[np.ix_(marks, marks)])
    good = value > 1e-6 * value.max()  # equal texts make the landmarks' kernel singular
    phi = np.column_stack([want[:, marks] @ vector[:, good] / np.sqrt(value[good]), np.ones(120)])
    w = np.array([1 / langs.count(x) for x in langs])
    f = phi @ np.linalg.lstsq(np.vstack([phi * np.sqrt(w)[:, None], 0.1 * np.eye(phi.shape[1])]), np.vstack([np.where([[x == y for y in sorted(set(langs))] for x in langs], 1.0, -1.0) * np.sqrt(w)[:, None], np.zeros((phi.shape[1], 3))]), rcond=None)[0]
    pred, score = model.predict(s)
    assert np.allclose(score, np.clip((f.max(axis=1) + 1) / 2, 0, 1), atol=2e-3) and pred.tolist() == [sorted(set(langs))[i] for i in f.argmax(axis=1)]


def test_language_id_repeated_ids_and_clashing_columns(spark):
    texts, langs = languages()
    docs = table(spark, texts[:60] + ["x" * 5000], langs=langs[:60] + [None], ids=[i // 2 for i in range(60)] + [0]).selectExpr("*", "1 AS _row_of_scoring", "2 AS key")
    model = language_id.fit(docs, F.lit(True))
    got = Counter((r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect())
    assert sum(got.values()) == 61 and sum(got[i // 2, lang] > 0 for i, lang in enumerate(langs[:60])) >= 57
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 61


def test_language_id_learns_every_language(spark):
    rnd = random.Random(5)
    texts, langs = [], []
    for i in range(70):  # each with letters of its own
        letters = [chr(0x4E00 + 7 * i + j) for j in range(5)]
        for _ in range(3 if i < 69 else 2):
            texts.append(" ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(12)))
            langs.append(f"l{i:02d}")
    docs = table(spark, texts, langs=langs)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit(docs, F.lit(True))).collect()}
    assert set(got.values()) == set(langs)
    assert sum(got[i] == lang for i, lang in enumerate(langs)) >= 0.95 * len(langs)


def test_language_stage_rejects_letterless_texts_without_a_model(spark):
    texts = ["one two", None, "12 34 --", "", "été"]
    for langs in ([None] * 5, ["en", "en", "en", "en", "fr"]):
        docs = table(spark, texts, langs=langs)
        kept = language_id.keep_identified(docs, language_id.fit(docs, F.lit(True)))
        assert sorted(r.doc_id for r in kept.collect()) == [0, 4]


def test_toxicity_learns_stems(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice(["ta", "ri", "mo", "ne", "lu", "sh"]) for _ in range(3)) for _ in range(300)]
    texts, marks = [], []
    for i in range(300):
        w = [rnd.choice(words) for _ in range(30)]
        if i % 4 == 0:
            w[rnd.randrange(30)] = "badword" + rnd.choice(["en", "er", ""])
        marks.append(int(i % 4 == 0))
        texts.append(" ".join(w))
    docs = table(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, language_id.remainder("doc_id", 3) != 1)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [d for d in range(300) if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum((got[d] >= 0.7) == bool(marks[d]) for d in held) >= 0.97 * len(held)
    assert got[300] == got[301] < 0.7 and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels.where("toxic = 1"), F.lit(True))).collect()} == {0.0}


def test_toxicity_matches_brute_force(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["ab", "cde", "Fgh", "ñu", "zz", "qe"]) for _ in range(12)) + (" vile" if i % 3 == 0 else "") for i in range(40)]
    y = np.array([float(i % 3 == 0) for i in range(40)])
    sets = [grams_of(t, toxicity.SIZES) for t in texts]
    names = sorted(set().union(*sets))
    x = np.array([[float(g in s) for g in names] for s in sets])
    p, q = 1 + x[y == 1].sum(axis=0), 1 + x[y == 0].sum(axis=0)
    # columns that no text has count one in each class, too
    p_all, q_all = p.sum() + (1 << toxicity.BITS) - len(names), q.sum() + (1 << toxicity.BITS) - len(names)
    ratio = np.log((p / p_all) / (q / q_all))
    z, weight = x * ratio, np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    step, w, b = 1 / (0.25 * (1.1 * np.linalg.eigvalsh((z * weight[:, None]).T @ z).max() + 1) + toxicity.RIDGE), np.zeros(len(names)), 0.0
    pw, pb = w, b
    for t in range(3000):
        m = t / (t + 3)
        zw, zb = w + m * (w - pw), b + m * (b - pb)
        e = weight * (1 / (1 + np.exp(-(z @ zw + zb))) - y)
        pw, pb, w, b = w, b, zw - step * (z.T @ e + toxicity.RIDGE * zw), zb - step * e.sum()
    want = 1 / (1 + np.exp(-(z @ w + b)))
    docs, labels = table(spark, texts), spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels, F.lit(True))).collect()}
    assert max(abs(got[i] - want[i]) for i in range(40)) < 0.05 and all((got[i] > 0.5) == (want[i] > 0.5) for i in range(40))


def test_toxicity_repeated_ids_and_empty_tables(spark):
    docs = table(spark, ["vile words", "fair words", "vile thing", "fine thing", "vile"], ids=[1, 2, 1, 2, 7])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert toxicity.score_toxicity(docs, model).count() == 5 and toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels, F.lit(True)).weights is None and toxicity.fit(docs, labels.limit(0), F.lit(True)).weights is None


def test_mixing_keeps_clashing_columns(spark):
    docs = table(spark, ["a b c", "d e", None, "f"], sources=["s", "t", "t", None]).selectExpr("*", "1 AS _c", "2 AS _d", "3 AS _s", "4 AS _n")
    got = source_mixing.mixed_documents(docs)
    assert got.columns == docs.columns and {(r._c, r._d, r._s, r._n) for r in got.collect()} == {(1, 2, 3, 4)}


def test_mixing_targets_and_apportionment(spark):
    rnd = random.Random(6)
    texts = [None if i % 50 == 0 else " ".join(["w"] * rnd.randint(0, 80)) for i in range(400)]
    sources = [None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 40}" for i in range(400)]
    docs = table(spark, texts, sources=sources)
    got = source_mixing.mix_sources(docs, shard_words=500).collect()
    size = Counter()
    for t, s in zip(texts, sources, strict=True):
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
    assert len(got) == 400 and all(abs(taken[s] - target[s]) <= 40 for s in order)
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(map(tuple, source_mixing.mix_sources(docs.repartition(7), shard_words=500).collect()), key=lambda r: r[0])
    assert {r.taken for r in source_mixing.mix_sources(table(spark, [None, ""])).collect()} == {0}
    assert source_mixing.mix_sources(docs.limit(0)).count() == 0
    assert source_mixing.mixed_documents(docs).columns == docs.columns


def test_seats_are_sainte_lague(spark):
    for weights, seats in ([53, 24, 23], 7), ([1000, 1, 1, 1], 10), ([5, 5, 5], 4), ([700, 200, 100], 2), ([3, 0, 9], 5):
        frame = spark.createDataFrame([("g", i, float(w), seats) for i, w in enumerate(weights)], "g string, i int, w double, seats long")
        got = {r.i: r.won for r in source_mixing._seats(frame, "w", "seats", ["g"], [F.col("i")]).collect()}
        won = [0] * len(weights)
        for _ in range(seats):
            won[max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
        assert [got[i] for i in range(len(weights))] == won


def test_vector_search_recall_and_awkward_vectors(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(800, 24))
    x[5:30] = x[4]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(1000, None, 1), (1020, [], 1), (1040, [0.0] * 24, 1), (1060, [float("nan")] + [1.0] * 23, 1), (1080, [1.0] * 5, 1), (1100, [None] + [1.0] * 23, 1), (None, [1.0] * 24, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {}
    for r in vector_search.nearest(frame, frame.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 800, 20)) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    hits = 0
    for q, g in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(800), -score))[:20]
        hits += len({v for v, _ in g.values()} & set(best.tolist()))
        flat = [g[i] for i in range(1, 21)]
        assert flat == sorted(flat, key=lambda p: (-p[1], p[0])) and all(abs(s - score[v]) < 1e-9 for v, s in flat)
    assert hits >= 0.9 * 20 * len(got)
    few = vector_search.nearest(frame.where("vec_id < 5"), frame.where("vec_id = 0")).collect()
    assert [r.rank for r in few] == [1, 2, 3, 4]
    assert vector_search.nearest(frame.limit(0), frame).count() == 0


def test_vector_search_repeated_ids_and_several_lengths(spark):
    rnd = np.random.default_rng(7)
    x, y = rnd.normal(size=(60, 8)), rnd.normal(size=(7, 3))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(20, [float(v) for v in -x[20]])] + [(100 + 20 * i, [float(v) for v in r]) for i, r in enumerate(y)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = vector_search.nearest(frame, frame.where("vec_id % 20 = 0"), k=20).collect()
    count = Counter(r.query_id for r in got)
    assert count == {0: 20, 20: 40, 40: 20} | {100 + 20 * i: 6 for i in range(7)}
    assert {r.vec_id for r in got if r.query_id == 100} == {120 + 20 * i for i in range(6)}
    tops = [(r.query_id, r.vec_id) for r in got if r.rank == 1]
    assert sum(q == 20 for q, _ in tops) == 2 and all(r.vec_id != r.query_id for r in got)


def test_kept_hash_of_op1(spark, sf):
    rows = substring_dedup.op1_substring_dedup(spark, sf).where("n_removed = 0").limit(3).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows:
        assert r.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(text[r.doc_id] or "")).encode()).hexdigest()
