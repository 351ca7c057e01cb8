"""I-Match fingerprints against a plain version, with the awkward cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

from ledgerloom.llm import fingerprints

SCHEMA = "doc_id long, text string, subset string, bucket int, word string"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash", 3, "w") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA).repartition(3)


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    new = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [None, "", " \t", "...", "one", "One, TWO", "é ü É", new(4000)] + [new(rnd.randint(30, 200)) for _ in range(30)]
    return texts + [texts[8], texts[8] + " w1x", texts[9].replace("w1", "q"), "same " * 50, "same " * 51]


def plain(rows):
    """{place: (doc_id, n_chars, edited, fingerprint, edited fingerprint, near_edited, near_next)}; rows by descending id, null last, then text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    found = lambda t: set(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower()))
    df = Counter(w for _, t in rows for w in found(t))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()

    def entries(t):
        own = found(t)
        own = sorted(w for w in own if len(own) <= 32 or (df[w] * 200 >= len(rows) and 0 < df[w] * 5 <= len(rows)))
        parts = {}
        for w in own:
            parts.setdefault(int(md5(w)[:6], 16) % 64, []).append(w)
        return [f"{p:02X}{md5(' '.join(ws))[:8]}" for p, ws in sorted(parts.items())] or ["--" + hashlib.sha256(t.encode()).hexdigest()[:8]]

    near = lambda a, b: len(set(a) & set(b)) / len({x[:2] for x in a + b})
    out = []
    for k, (i, t) in enumerate(rows):
        follows, h = rows[(k + 1) % len(rows)][1], len(t) // 2
        edit = t[: len(t) - h] + follows[:h]
        a, b, c = entries(t), entries(edit), entries(follows)
        out.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), "".join(a), "".join(b), near(a, b), near(a, c)))
    return out


def result(df):
    return sorted(df.collect(), key=repr)


@pytest.mark.parametrize("ids", [None, [5, 5, None, None, *range(10, 49)]])
def test_fingerprints_match_a_plain_version(spark, ids):
    texts = corpus()
    ids = ids and ids[: len(texts)]
    got = result(fingerprints.edited_fingerprints(table(spark, texts, ids)))
    want = sorted(plain(zip(ids or range(len(texts)), texts, strict=True)), key=repr)
    assert [tuple(r) for r in sorted(got, key=lambda r: repr(tuple(r)))] == want


def test_small_and_empty_tables(spark):
    assert fingerprints.edited_fingerprints(table(spark, ["a"]).limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(table(spark, ["only one text"])).first()
    assert one.near_next == 1.0 and one.n_chars == 13
    assert [r.n_chars for r in fingerprints.edited_fingerprints(table(spark, [None, None], [None, None])).collect()] == [0, 0]


def test_equal_texts_equal_near_texts_near(spark):
    texts = corpus()
    got = {r.doc_id: r for r in fingerprints.fingerprints(table(spark, texts)).collect()}
    n = len(texts)
    assert got[n - 5].fingerprint == got[8].fingerprint and got[0].fingerprint == got[1].fingerprint
    assert got[n - 2].digest != got[n - 1].digest and got[n - 2].fingerprint == got[n - 1].fingerprint  # the same terms
    cut = lambda f: {f[i : i + 10] for i in range(0, len(f), 10)}
    assert len(cut(got[n - 4].fingerprint) ^ cut(got[8].fingerprint)) <= 2


def test_large_lexicons_are_joined_without_broadcast(spark, monkeypatch):
    want = result(fingerprints.edited_fingerprints(table(spark, corpus())))
    monkeypatch.setattr(fingerprints, "BROADCAST_TERMS", 0)
    assert result(fingerprints.edited_fingerprints(table(spark, corpus()))) == want


def test_sql_equals_the_query(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(fingerprints.ORACLE)
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(dict(zip(names, r, strict=True)).values()) for r in cursor.fetchall())
    assert sorted(tuple(r) for r in fingerprints.op13_fingerprints(spark, sf).select(*names).collect()) == want
