"""Every registered query that has SQL equals it."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.plans import catalog, oracle

PLAIN = [n for n in catalog.queries()]


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(map(plain, r))) for r in frame.values.tolist())


@pytest.mark.parametrize("name", PLAIN)
def test_query_equals_sql(spark, sf, db, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), db.sql(oracle.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and rows(got) == rows(want)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(oracle.ORACLE) == set(PLAIN) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hybrid_recall_has_both_lanes(spark, sf):
    import numpy as np

    from ledgerloom.operators import search
    from ledgerloom.plans import views as V

    got = [r.seq for r in __spark_entry__.queries()["recall_hybrid"](spark, sf).collect()]
    texts = V.texts(catalog.claims(spark, sf).unionByName(catalog.spoken(spark, sf)))
    rows_ = V.embeddable(texts).select("session", "seq", "kind", search.hashed_embedding("text").alias("v")).collect()
    q = np.array(search.embed_query("urgent order", spark))
    v = np.array([r.v for r in rows_])
    cosine = np.round(v @ q / np.maximum(np.linalg.norm(v, axis=1) * np.linalg.norm(q), 1e-12), 9)
    nearest = [rows_[i] for i in sorted(range(len(rows_)), key=lambda i: (-cosine[i], rows_[i].session, rows_[i].seq))[:3]]
    spoken_word = {r.seq for r in search.bm25(texts, "urgent order", 24, ["session", "seq"]).collect()}
    assert 0 < len(got) <= 12 and all(r.seq in got for r in nearest if r.kind == "obs") and any(r.kind == "obs" for r in nearest)
    assert set(got) & spoken_word


def test_indexed_recall_finds_what_a_scan_finds(spark, sf):
    from ledgerloom.operators import search
    from ledgerloom.plans import views as V

    now = catalog.revised(spark, sf).snapshot()
    texts = V.texts(now.view("log"))
    got = [(r.kind, r.seq) for r in catalog.store_recall(spark, sf).collect()]
    vectors = V.embeddable(texts).select("session", "seq", search.hashed_embedding("text").alias("vector"))
    hits = search.hybrid(texts, vectors, "urgent order", search.embed_query("urgent order", spark), 24)
    want = {r.seq for r in hits.orderBy(F.desc("score"), "session", "seq").limit(12).collect()}
    assert len(got) == 12 and len(want & {s for _, s in got}) >= 10


def test_places_and_sessions(tmp_path, monkeypatch):
    from ledgerloom.sources import ledger as L

    desk, anchor = tmp_path / "desk/deep", tmp_path / "anchor/.ledger"
    desk.mkdir(parents=True), anchor.mkdir(parents=True), (tmp_path / "desk/.git").mkdir(), (tmp_path / "desk/.ledger").mkdir()
    monkeypatch.delenv("LEDGER_STORE", raising=False)
    assert L.folder(str(desk)) == tmp_path / "desk/.ledger" and L.location(str(desk)) == str(tmp_path / "desk/.ledger/store")
    assert L.current_session(None, str(desk)) is None and L.current_session(" s1 ", str(desk)) == "s1"
    (tmp_path / "desk/.ledger/redirect").write_text("../anchor/.ledger\n")
    (anchor / "current-session").write_text("s2\n")
    assert L.location(str(desk)).endswith("desk/../anchor/.ledger/store") and L.current_session(None, str(desk)) == "s2"
    (tmp_path / "desk/.ledger/current-session").write_text("s3")
    assert L.current_session(None, str(desk)) == "s3"
    monkeypatch.setenv("LEDGER_STORE", "hdfs://x/y")
    assert L.location(str(desk)) == "hdfs://x/y"
