"""Views of the ledger. Each is a function of the latest rows, so a replaced event needs no retraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cited, day_of, is_blank
from ..schema import EMBED_USER_BYTES

SEARCHABLE = ("obs", "final", "said", "compact", "user")


def days(ledger: DataFrame) -> DataFrame:
    """day, tools, fails, commits, sessions, touches: a row a UTC day with mechanical events."""
    kind = F.col("kind")
    return (
        ledger.where(kind.isin("meta", "tool", "commit", "file"))
        .groupBy(day_of(F.col("ts_ms")).alias("day"))
        .agg(
            F.count_if(kind == "tool").alias("tools"),
            F.count_if((kind == "tool") & ~F.col("ok")).alias("fails"),
            F.count_if(kind == "commit").alias("commits"),
            F.count_if(kind == "meta").alias("sessions"),
            F.count_if(kind == "file").alias("touches"),
        )
    )


def day_files(ledger: DataFrame) -> DataFrame:
    """day, path, n"""
    return ledger.where("kind = 'file'").groupBy(day_of(F.col("ts_ms")).alias("day"), "path").agg(F.count(F.lit(1)).alias("n"))


def file_sessions(ledger: DataFrame) -> DataFrame:
    """path, session: each pair once."""
    return ledger.where("kind = 'file'").select("path", "session").distinct()


def texts(ledger: DataFrame) -> DataFrame:
    """session, seq, text, kind, ts_ms, cited, basis of all that is searchable."""
    mark = F.when(F.col("kind") == "obs", cited(F.col("derived_from"))).otherwise(F.lit(True))
    return ledger.where(F.col("kind").isin(*SEARCHABLE) & ~is_blank(F.col("text"))).select("session", "seq", "text", "kind", "ts_ms", mark.alias("cited"), "basis")


def embeddable(text_rows: DataFrame) -> DataFrame:
    """The texts worth a vector: no running remarks, and only short requests."""
    return text_rows.where((F.col("kind") != "said") & ((F.col("kind") != "user") | (F.octet_length("text") <= EMBED_USER_BYTES)))


def evidence(ledger: DataFrame) -> DataFrame:
    """subject, session, seq, ts_ms, text, cited, basis: every claim."""
    return ledger.where("kind = 'obs'").select("subject", "session", "seq", "ts_ms", "text", cited(F.col("derived_from")).alias("cited"), "basis")


def _newest() -> Column:
    return F.struct("ts_ms", "seq", "session")


def subjects(claims: DataFrame) -> DataFrame:
    """subject, support, last_ms, text, cited, basis: the newest claim wins by (ts_ms, seq, session)."""
    won = F.max_by(F.struct("text", "cited", "basis"), _newest())
    out = claims.groupBy("subject").agg(F.count(F.lit(1)).alias("support"), F.max("ts_ms").alias("last_ms"), won.alias("w"))
    return out.select("subject", "support", "last_ms", "w.text", "w.cited", "w.basis")


def sessions(ledger: DataFrame) -> DataFrame:
    """session, start_ms, end_ms, cwd, branch, final_msg, commits; only meta, final, commit and tool events count."""
    kind, when = F.col("kind"), F.struct("ts_ms", "seq")
    only = lambda k, v: F.max_by(F.when(kind == k, F.col(v)), F.when(kind == k, when))
    return (
        ledger.where(kind.isin("meta", "final", "commit", "tool"))
        .groupBy("session")
        .agg(
            F.min("ts_ms").alias("start_ms"),
            F.max("ts_ms").alias("end_ms"),
            F.coalesce(only("meta", "cwd"), F.lit("")).alias("cwd"),
            only("meta", "branch").alias("branch"),
            F.coalesce(only("final", "text"), F.lit("")).alias("final_msg"),
            F.count_if(kind == "commit").alias("commits"),
        )
    )


def obs_per_day(claims: DataFrame) -> DataFrame:
    return claims.groupBy(day_of(F.col("ts_ms")).alias("day")).agg(F.count(F.lit(1)).alias("obs"))
