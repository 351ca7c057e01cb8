"""Scalar functions against plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as X


def one(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}").coalesce(1).orderBy("i").select(expr).collect()]


@pytest.mark.parametrize("most", [3, 4, 5, 6, 7, 8])
def test_byte_cap(spark, most):
    texts = ["", "abc", "abcdefghij", "ééééé", "中中中", "😀😀", "aé中😀", "aaaa😀"]
    cut = lambda s: s.encode()[:most].decode("utf-8", "ignore") if len(s.encode()) > most else s
    assert one(spark, texts, X.byte_cap(F.col("s"), most)) == [cut(t) for t in texts]


def test_clip_and_blank(spark):
    texts = ["  a  b\tc ", "x" * 6, "abcdef g", "é  é", " \n"]
    assert one(spark, texts, X.clip(F.col("s"), 5)) == ["a b c", "xxxxx…", "abcde…", "é é", ""]
    assert one(spark, texts, X.is_blank(F.col("s"))) == [False, False, False, False, True]


def test_short_count(spark):
    values = [0, 12, 999, 1000, 1234, 1050, 1150, 4550, 9949, 9999, 10_000, 10_500, 11_500, 14_036, -1234, 1_234_567]
    want = [str(v) if abs(v) < 1000 else f"{v / 1000:.1f}k" if abs(v) < 10_000 else f"{v / 1000:.0f}k" for v in values]
    assert one(spark, values, X.short_count(F.col("s")), "long") == want


def test_paths_ages_and_labels(spark):
    assert one(spark, ["a/b/c/d.rs", "a/b", "c", "/x/y"], X.short_path(F.col("s"))) == ["…/c/d.rs", "a/b", "c", "…/x/y"]
    now = 100 * 86_400_000
    ages = [now, now + 5, now - 3_599_999, now - 3_600_000, now - 86_399_999, now - 86_400_000, 0]
    assert one(spark, ages, X.age_label(now, F.col("s")), "long") == ["<1h", "<1h", "<1h", "1h", "23h", "1d", "100d"]
    assert one(spark, [100, 99, 90], X.day_label(F.col("s"), 100), "long") == ["today", "yesterday", "10d ago"]
    assert one(spark, ["a-b.c_9", "two words", "é"], X.subject_handle(F.col("s"), "ledger")) == ["ledger a-b.c_9", 'ledger recall --subject "two words"', 'ledger recall --subject "é"']


def test_iso_times(spark):
    texts = ["2026-08-10T19:18:11.311Z", "2026-08-10T19:18:11Z", "2026-08-10T19:18:11.311+02:00", "garbage", "", None, "2026-13-10T19:18:11.311Z"]
    assert one(spark, texts, X.iso_to_ms(F.col("s"))) == [1786389491311, 1786389491000, 1786389491311, None, None, None, None]
    assert one(spark, [1786389491311], X.date_label(F.col("s")), "long") == ["2026-08-10"]
    assert one(spark, ["2026-07-01", "2026-01-01"], X.local_day_ms(F.col("s"), "12:00:00", "Europe/Berlin")) == [1782900000000, 1767265200000]


def test_iso_weeks(spark):
    dates = ["2026-08-17", "2027-01-01", "2024-12-30", "2021-01-03"]
    d = F.col("s").cast("date")
    import datetime

    want = [datetime.date.fromisoformat(x).isocalendar()[:2] for x in dates]
    assert list(zip(one(spark, dates, X.iso_year(d)), one(spark, dates, X.iso_week(d)), strict=True)) == want


def test_lint(spark):
    texts = ["we shipped it Tonight", "a rule that holds", "this  session"]
    assert one(spark, texts, X.lint_reasons(F.col("s"))) == [["tonight", "shipped"], [], []]
    assert one(spark, ["x" * 240, "é" * 241], X.is_long_claim(F.col("s"))) == [False, True]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=30), st.integers(0, 9))
def test_byte_cap_property(spark, texts, most):
    texts = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    for t, got in zip(texts, one(spark, texts, X.byte_cap(F.col("s"), most)), strict=True):
        assert t.startswith(got) and len(got.encode()) <= most and (got == t or len(t[: len(got) + 1].encode()) > most)
