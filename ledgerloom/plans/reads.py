"""Reads of the ledger. Each takes DataFrames and a given ``now`` (never the wall clock) and returns DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import search
from ..schema import DAY_MS, HOUR_MS
from . import timeline as C
from . import views as V

BUDGET = 8


def commits_since(claims: DataFrame, days: DataFrame) -> DataFrame:
    """``claims`` with ``since``: commits on days strictly after each claim's day.

    The inequality is met only between the distinct days of both sides; claims then join on their day.
    """
    rows = claims.withColumn("_day", X.day_of(F.col("ts_ms")))
    later = rows.select("_day").distinct().join(days.select("day", "commits"), F.col("day") > F.col("_day"), "left")
    later = later.groupBy("_day").agg(F.coalesce(F.sum("commits"), F.lit(0)).cast("bigint").alias("since"))
    return rows.join(later, "_day").drop("_day")


def matching(rows: DataFrame, now: int, session: str | None = None, kind: str | None = None, since_days: int | None = None) -> DataFrame:
    """The shared filter: session prefix, kind, age."""
    if session is not None:
        rows = rows.where(F.col("session").startswith(session))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if since_days is not None:
        rows = rows.where(F.col("ts_ms") >= max(0, now - since_days * DAY_MS))
    return rows


def events(ledger: DataFrame, now: int, **filters) -> DataFrame:
    return matching(ledger, now, **filters).orderBy("ts_ms", "session", "seq")


def recent_days(days: DataFrame, n: int = 3) -> DataFrame:
    return days.orderBy(F.desc("day")).limit(n)


def day_digest(days: DataFrame, day_files: DataFrame, now: int, n: int = 3, files: int = 4) -> DataFrame:
    shown = recent_days(days, n)
    order = Window.partitionBy("day").orderBy(F.desc("n"), "path")
    top = day_files.join(shown.select("day"), "day", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= files)
    top = top.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("r", X.short_path(F.col("path")).alias("p"))))["p"].alias("files"))
    out = shown.join(top, "day", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    return out.select("day", X.day_label(F.col("day"), now // DAY_MS).alias("label"), "tools", "fails", "commits", "sessions", "files").orderBy(F.desc("day"))


def active_sessions(sessions: DataFrame, now: int, n: int = 6) -> DataFrame:
    rows = sessions.where(F.greatest(F.lit(now) - F.col("end_ms"), F.lit(0)) < HOUR_MS).orderBy(F.desc("end_ms"), "session").limit(n)
    return rows.select("session", "end_ms", X.place(F.col("cwd")).alias("where"), X.age_label(now, F.col("end_ms")).alias("age"), "commits")


def last_session(sessions: DataFrame, now: int) -> DataFrame:
    rows = sessions.where("final_msg <> ''").orderBy(F.desc("end_ms"), "session").limit(1)
    return rows.select(X.age_label(now, F.col("end_ms")).alias("age"), "branch", "final_msg")


def top_files(days: DataFrame, day_files: DataFrame, file_sessions: DataFrame, n: int = 5) -> DataFrame:
    shown = recent_days(days)
    best = day_files.join(shown.select("day"), "day", "left_semi").groupBy("path").agg(F.sum("n").alias("touches")).orderBy(F.desc("touches"), "path").limit(n)
    who = file_sessions.join(best.select("path"), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_set("session")).alias("s"))
    return best.join(who, "path").select(X.short_path(F.col("path")).alias("path"), "touches", F.transform("s", X.short_session).alias("sessions")).orderBy(F.desc("touches"), "path")


def subjects_report(subjects: DataFrame, days: DataFrame, now: int, n: int | None = None) -> DataFrame:
    rows = subjects.orderBy(F.desc("last_ms"), "subject").limit(n) if n else subjects
    rows = commits_since(rows.withColumnRenamed("last_ms", "ts_ms"), days)
    basis = F.when(F.col("basis").isNotNull(), X.basis_label_with(F.col("basis"), F.col("since")))
    return rows.select("subject", "support", "cited", X.age_label(now, F.col("ts_ms")).alias("age"), "text", basis.alias("basis"), F.when(F.col("basis").isNotNull(), F.col("since")).alias("commits_since"), F.col("ts_ms").alias("last_ms"), X.subject_handle(F.col("subject"), C.COMMAND).alias("handle"))


def further(spark, days: DataFrame, day_files: DataFrame, obs_per_day: DataFrame, now: int, budget: int = BUDGET) -> DataFrame:
    """Bands below the oldest of the three days shown."""
    first = days.agg(F.min("day")).first()[0]
    shown = [r.day for r in recent_days(days).select("day").collect()]
    return C.digest(spark, C.bands(first, min(shown, default=now // DAY_MS), budget), days, day_files, obs_per_day)


def relevant(texts: DataFrame, fused: DataFrame, now: int) -> DataFrame:
    """The best texts of a task, at most two a session."""
    rows = fused.join(texts, ["session", "seq"])
    tag = F.concat("kind", F.when((F.col("kind") == "obs") & F.col("cited"), F.lit("·cited")).otherwise(F.lit("")), F.lit(" · "), X.age_label(now, F.col("ts_ms")))
    return search.diversity_cap(rows, ["session", "seq"]).select("session", "seq", "score", tag.alias("tag"), "text")


def fused(texts: DataFrame, query: str, n: int, embedder: search.Embedder = search.hashed_embedding) -> DataFrame:
    spark = texts.sparkSession
    vectors = V.embeddable(texts).select("session", "seq", embedder(F.col("text")).alias("vector"))
    return search.hybrid(texts, vectors, query, search.embed_query(query, spark, embedder), n)


def brief(ledger: DataFrame, now: int, task: str = "", budget: int = BUDGET) -> dict[str, DataFrame]:
    spark = ledger.sparkSession
    days, files, claims, texts = V.days(ledger), V.day_files(ledger), V.evidence(ledger), V.texts(ledger)
    sessions = V.sessions(ledger)
    out = {
        "today": spark.range(1).select(X.date_label(F.lit(now)).alias("today")),
        "active": active_sessions(sessions, now),
        "days": day_digest(days, files, now),
        "further": further(spark, days, files, V.obs_per_day(claims), now, budget),
        "last_session": last_session(sessions, now),
        "files": top_files(days, files, V.file_sessions(ledger)),
        "subjects": subjects_report(V.subjects(claims), days, now, 5),
    }
    if task.strip():
        out["relevant"] = relevant(texts, fused(texts, task, 12), now)
    return out


#: Names of the sections' fields as other programs read them, by ours.
CONTRACT = {
    "active": {"where": "where", "session": "session", "age": "age", "commits": "commits"},
    "days": {"label": "day", "tools": "tools", "fails": "fails", "commits": "commits", "sessions": "sessions", "files": "files"},
    "last_session": {"age": "age", "branch": "branch", "final_msg": "final_msg"},
    "files": {"path": "path", "sessions": "sessions"},
    "relevant": {"tag": "tag", "text": "text"},
    "subjects": {"subject": "subject", "support": "count", "cited": "cited", "age": "age", "basis": "basis", "text": "text", "handle": "handle"},
}


def json_lines(sections: dict[str, DataFrame], contract: dict[str, dict[str, str]] = CONTRACT) -> DataFrame:
    """section and json, a row a row: the sections of a brief or a zoom as objects with the contract's fields, nulls included and whole texts."""
    fields = lambda n, df: contract.get(n) or {c: c for c in df.columns if c != "band"}
    rows = [df.select(F.lit(n).alias("section"), F.to_json(F.struct(*(F.col(c).alias(to) for c, to in fields(n, df).items())), {"ignoreNullFields": "false"}).alias("json")) for n, df in sections.items()]
    return reduce(DataFrame.unionByName, rows)


def asof(ledger: DataFrame, cutoff: int, task: str = "", budget: int = BUDGET) -> dict[str, DataFrame]:
    """The brief of what was true by ``cutoff``: events whose own time is not later."""
    return brief(ledger.where(F.col("ts_ms") <= cutoff), cutoff, task, budget)


def recall(ledger: DataFrame, query: str, now: int, limit: int = 12, **filters) -> DataFrame:
    """Fused hits, filtered after the fusion, best first."""
    if not query.strip():
        raise ValueError("nothing to look for")
    texts = V.texts(ledger)
    return hydrated(texts, fused(texts, query, 2 * limit), V.days(ledger), now, limit, **filters)


def hydrated(texts: DataFrame, hits: DataFrame, days: DataFrame, now: int, limit: int, **filters) -> DataFrame:
    rows = matching(hits.join(texts, ["session", "seq"]), now, **filters).orderBy(F.desc("score"), "session", "seq").limit(limit)
    rows = commits_since(rows, days)
    basis = F.when((F.col("kind") == "obs") & F.col("basis").isNotNull(), X.basis_label_with(F.col("basis"), F.col("since")))
    out = rows.select(F.round("score", 3).alias("score"), "kind", "cited", X.age_label(now, F.col("ts_ms")).alias("age"), X.short_session(F.col("session")).alias("session"), "seq", basis.alias("basis"), "text", F.col("score").alias("_s"), F.col("session").alias("_id"))
    return out.orderBy(F.desc("_s"), "_id", "seq").drop("_s", "_id")


def trail(claims: DataFrame, days: DataFrame, subject: str, now: int) -> DataFrame:
    """A subject's claims, newest first."""
    rows = commits_since(claims.where(F.col("subject") == subject), days)
    rows = rows.withColumn("commits_since", F.when(F.col("basis").isNotNull(), F.col("since")))
    return rows.select("session", "seq", "ts_ms", X.age_label(now, F.col("ts_ms")).alias("age"), "cited", "basis", "commits_since", "text").orderBy(F.desc("ts_ms"), F.desc("seq"), F.desc("session"))


def find_session(sessions: DataFrame, prefix: str) -> DataFrame:
    return sessions.where(F.col("session").startswith(prefix)).orderBy("session").limit(1)


def show_session(ledger: DataFrame, prefix: str) -> dict[str, DataFrame]:
    found = find_session(V.sessions(ledger), prefix)
    name = F.element_at(F.split("cwd", "/"), -1)
    noise = F.col("branch").isNull() | F.col("branch").endswith(name) | name.endswith(F.col("branch"))
    head = found.withColumns({"place": X.place(F.col("cwd")), "shown_branch": F.when(~noise, F.col("branch"))})
    said = V.evidence(ledger).join(found.select("session"), "session", "left_semi").orderBy("ts_ms", "seq")
    return {"session": head, "observations": said}


def show_event(ledger: DataFrame, prefix: str, seq: int) -> dict[str, DataFrame]:
    found = find_session(V.sessions(ledger), prefix).select("session")
    rows = ledger.join(found, "session", "left_semi")
    return {"event": rows.where(F.col("seq") == seq), "citers": citers(rows, seq)}


def citers(ledger: DataFrame, seq: int) -> DataFrame:
    return ledger.where((F.col("kind") == "obs") & F.array_contains("derived_from", F.lit(seq).cast("bigint"))).select("session", "seq", "ts_ms", "subject", "text").orderBy("session", "seq")


def all_citations(ledger: DataFrame) -> DataFrame:
    """Each event with the claims of its session that cite it."""
    cites = ledger.where("kind = 'obs'").select("session", F.col("seq").alias("citer"), F.explode("derived_from").alias("seq"))
    return ledger.select("session", "seq", "kind").join(cites, ["session", "seq"])


def overlapping(sessions: DataFrame, span: C.Span) -> DataFrame:
    lo, hi = span.start * DAY_MS, (span.end + 1) * DAY_MS
    return sessions.where((F.col("start_ms") < hi) & (F.col("end_ms") >= lo)).orderBy(F.desc("end_ms"), "session")


def within(rows: DataFrame, span: C.Span) -> DataFrame:
    return rows.where((F.col("ts_ms") >= span.start * DAY_MS) & (F.col("ts_ms") < (span.end + 1) * DAY_MS))


def zoom(ledger: DataFrame, span: C.Span) -> dict[str, DataFrame]:
    """A window's digest, the children with any activity, sessions that overlap it, its last closing texts and its claims."""
    spark = ledger.sparkSession
    days, files, claims = V.days(ledger), V.day_files(ledger), V.evidence(ledger)
    per_day = V.obs_per_day(claims)
    parts = C.digest(spark, C.children(span.start, span.end), days, files, per_day)
    said = within(V.texts(ledger).where("kind in ('final', 'compact')"), span)
    return {
        "digest": C.digest(spark, [span], days, files, per_day),
        "children": parts.where("tools + commits + obs > 0").orderBy("band"),
        "sessions": overlapping(V.sessions(ledger), span),
        "said": said.orderBy(F.desc("ts_ms"), "session", "seq").limit(4).select("session", "seq", "ts_ms", "text"),
        "observations": within(claims, span).orderBy("ts_ms", "session", "seq").select("subject", "session", "seq", "cited", "text"),
    }


def dispatch(ledger: DataFrame, words: list[str], now: int):
    """What a row of words asks for: (name, result). A place in time, a session, a subject, or else a search."""
    if not words:
        return "brief", brief(ledger, now)
    if len(words) == 1 and (span := C.parse_window(words[0], now // DAY_MS)):
        return "zoom", zoom(ledger, span)
    if re.fullmatch(r"[0-9a-fA-F-]{6,}", words[0]) and (len(words) == 1 or len(words) == 2 and words[1].isdigit()):
        return "show", show_session(ledger, words[0]) if len(words) == 1 else show_event(ledger, words[0], int(words[1]))
    claims = V.evidence(ledger)
    if len(words) == 1 and not claims.where(F.col("subject") == words[0]).isEmpty():
        return "trail", trail(claims, V.days(ledger), words[0], now)
    return "recall", recall(ledger, " ".join(words), now)
