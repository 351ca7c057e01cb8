"""Registered queries over the test tables, and the SQL each is held against.

The tables stand for a ledger: ``events`` rows are mechanical events (a user is a session), ``conversations`` are spoken ones, and
``orders`` are claims (a customer group is a subject). All queries read whole tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from ..operators import search
from ..sources import ledger as L
from ..sources import transcripts as T
from ..streaming.store import Store
from . import timeline as C
from . import reads as R
from . import views as V


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def mechanical(spark, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    return S.conform(
        _t(spark, sf_dir, "events").select(
            F.col("user_id").cast("string").alias("session"),
            (F.col("event_id") * 16).alias("seq"),
            _millis("ts").alias("ts_ms"),
            F.when(kind == "signup", "meta").when(kind.isin("click", "error"), "tool").when(kind == "purchase", "commit").otherwise("file").alias("kind"),
            F.when(kind == "signup", F.concat(F.lit("/work/team"), (F.col("user_id") % 5).cast("string"), F.lit("/app"), (F.col("event_id") % 3).cast("string"))).alias("cwd"),
            F.when((kind == "signup") & (F.col("event_id") % 2 == 0), F.concat(F.lit("topic-"), (F.col("event_id") % 7).cast("string"))).alias("branch"),
            F.when(kind.isin("click", "error"), F.concat(F.lit("tool"), (F.col("event_id") % 4).cast("string"))).alias("tool"),
            F.when(kind.isin("click", "error"), F.concat(F.lit("run  step "), k.cast("string"))).alias("detail"),
            F.when(kind.isin("click", "error"), kind != "error").alias("ok"),
            F.when(kind == "view", F.concat(F.lit("src/mod"), (k % 6).cast("string"), F.lit("/file"), k.cast("string"), F.lit(".rs"))).alias("path"),
            F.when(kind == "purchase", F.md5(F.col("event_id").cast("string").cast("binary"))).alias("hash"),
            F.when(kind == "purchase", F.concat(F.lit("change "), F.col("event_id").cast("string"))).alias("message"),
        )
    )


def spoken(spark, sf_dir: str) -> DataFrame:
    """Turns of conversations; the last assistant turn is the closing message, short ones are not kept."""
    last = Window.partitionBy("conv_id", "role")
    rows = _t(spark, sf_dir, "conversations").withColumn("last", F.max("turn").over(last))
    kind = F.when(F.col("role") == "user", "user").when(F.col("turn") == F.col("last"), "final").when(F.octet_length("text") >= S.SAID_LEAST, "said")
    rows = rows.where("role <> 'system'").withColumn("kind", kind).where("kind is not null")
    text = F.when(F.col("kind") == "user", X.byte_cap(F.col("text"), S.USER_BYTES)).when(F.col("kind") == "final", X.byte_cap(F.col("text"), S.FINAL_BYTES)).otherwise(X.byte_cap(F.col("text"), S.SAID_BYTES))
    stamp = F.lit(1_704_067_200_000) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000
    return S.conform(rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session"), (F.col("turn") * 16 + 2).alias("seq"), stamp.alias("ts_ms"), "kind", text.alias("text")))


def claims(spark, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    key = F.col("o_custkey").cast("string")
    return S.conform(
        _t(spark, sf_dir, "orders").select(
            key.alias("session"),
            (F.lit(S.FIRST_OBS_SEQ) + o).alias("seq"),
            _millis("o_orderdate").alias("ts_ms"),
            F.lit("obs").alias("kind"),
            F.concat(F.lit("group "), (F.col("o_custkey") % 200).cast("string")).alias("subject"),
            F.concat(F.col("o_orderpriority"), F.lit(" order shipped in status "), F.col("o_orderstatus"), F.lit(" no "), o.cast("string")).alias("text"),
            F.when(o % 3 == 0, F.array(o * 16 % 4096, o * 16 % 4096 + 16)).otherwise(F.array().cast("array<bigint>")).alias("derived_from"),
            F.when(o % 2 == 0, F.struct(F.md5(o.cast("string").cast("binary")).alias("commit"), (o % 4 == 0).alias("dirty"))).alias("basis"),
        )
    )


def now_of(spark, sf_dir: str) -> int:
    return _t(spark, sf_dir, "events").agg(F.max(_millis("ts"))).first()[0]


def _order_days(spark, sf_dir: str) -> DataFrame:
    """A long day table: orders as commits, for the calendar and for drift."""
    day = X.day_of(_millis("o_orderdate")).alias("day")
    ok = F.col("o_orderstatus")
    return _t(spark, sf_dir, "orders").groupBy(day).agg(F.count(F.lit(1)).alias("tools"), F.count_if(ok == "F").alias("fails"), F.count_if(ok == "O").alias("commits"), F.count_if(ok == "P").alias("sessions"))


def _order_files(spark, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/area/"), F.col("o_orderpriority"))
    return _t(spark, sf_dir, "orders").groupBy(X.day_of(_millis("o_orderdate")).alias("day"), path.alias("path")).agg(F.count(F.lit(1)).alias("n"))


def _frontier(spark, sf_dir: str) -> tuple[int, int]:
    r = _order_days(spark, sf_dir).agg(F.min("day"), F.max("day")).first()
    return r[0], r[1]


# ---- queries


def day_digest(spark, sf_dir):
    m = mechanical(spark, sf_dir)
    return R.day_digest(V.days(m), V.day_files(m), now_of(spark, sf_dir)).withColumn("files", F.array_join("files", "|"))


def days_view(spark, sf_dir):
    return V.days(mechanical(spark, sf_dir))


def day_files_top4(spark, sf_dir):
    order = Window.partitionBy("day").orderBy(F.desc("n"), "path")
    return V.day_files(mechanical(spark, sf_dir)).withColumn("r", F.row_number().over(order).cast("bigint")).where("r <= 4")


def file_sessions(spark, sf_dir):
    return V.file_sessions(mechanical(spark, sf_dir)).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("session")), ",").alias("sessions"))


def sessions_summary(spark, sf_dir):
    return V.sessions(mechanical(spark, sf_dir).unionByName(spoken(spark, sf_dir)))


def active_sessions(spark, sf_dir):
    return R.active_sessions(V.sessions(mechanical(spark, sf_dir)), now_of(spark, sf_dir))


def last_session(spark, sf_dir):
    return R.last_session(V.sessions(spoken(spark, sf_dir)), 1_800_000_000_000)


def top_files(spark, sf_dir):
    m = mechanical(spark, sf_dir)
    return R.top_files(V.days(m), V.day_files(m), V.file_sessions(m)).withColumn("sessions", F.array_join("sessions", ","))


def subjects_newest_wins(spark, sf_dir):
    s = V.subjects(V.evidence(claims(spark, sf_dir)))
    return s.select("subject", "support", "last_ms", "text", "cited", F.coalesce(X.basis_label(F.col("basis")), F.lit("")).alias("basis"))


def evidence_trail(spark, sf_dir):
    return V.evidence(claims(spark, sf_dir)).select("subject", "session", "seq", "ts_ms", "text", "cited", F.coalesce(X.basis_label(F.col("basis")), F.lit("")).alias("basis"))


def subject_trail(spark, sf_dir):
    out = R.trail(V.evidence(claims(spark, sf_dir)), _order_days(spark, sf_dir), "group 7", 1_000_000_000_000)
    return out.select("session", "seq", "age", "cited", F.coalesce("commits_since", F.lit(-1)).alias("commits_since"), "text")


def commits_since(spark, sf_dir):
    return R.commits_since(V.subjects(V.evidence(claims(spark, sf_dir))).withColumnRenamed("last_ms", "ts_ms"), _order_days(spark, sf_dir)).select("subject", "ts_ms", "since")


def subjects_report(spark, sf_dir):
    out = R.subjects_report(V.subjects(V.evidence(claims(spark, sf_dir))), _order_days(spark, sf_dir), 1_000_000_000_000)
    return out.select("subject", "support", "cited", "age", "text", F.coalesce("basis", F.lit("")).alias("basis"), "last_ms", "handle")


def citers(spark, sf_dir):
    return R.all_citations(mechanical(spark, sf_dir).unionByName(claims(spark, sf_dir)))


def obs_per_day(spark, sf_dir):
    return V.obs_per_day(V.evidence(claims(spark, sf_dir)))


def texts_searchable(spark, sf_dir):
    rows = V.texts(claims(spark, sf_dir).unionByName(spoken(spark, sf_dir)))
    return rows.select("session", "seq", "kind", "ts_ms", "cited", F.md5(F.col("text").cast("binary")).alias("digest"))


def texts_embeddable(spark, sf_dir):
    return V.embeddable(V.texts(claims(spark, sf_dir).unionByName(spoken(spark, sf_dir)))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


def bm25_topk(spark, sf_dir):
    return search.bm25(_t(spark, sf_dir, "documents"), "the worthless erand of", 12, ["doc_id"]).withColumn("score", F.round("score", 6))


def _probe(spark, sf_dir) -> list[float]:
    return [float(x) for x in _t(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def vector_topk(spark, sf_dir):
    return search.vector_topk(_t(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 10, ["vec_id"]).withColumn("score", F.round("score", 6))


def rrf_fused(spark, sf_dir):
    kw = search.bm25(_t(spark, sf_dir, "documents"), "the of", 24, ["doc_id"]).withColumn("score", F.round("score", 9))
    vec = search.vector_topk(_t(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 24, ["vec_id"]).select(F.col("vec_id").alias("doc_id"), F.round("score", 9).alias("score"))
    return search.rrf([kw, vec], ["doc_id"]).withColumn("score", F.round("score", 9))


def _keyword_hits(spark, sf_dir, n: int, query: str = "urgent order of the") -> tuple[DataFrame, DataFrame]:
    texts = V.texts(claims(spark, sf_dir).unionByName(spoken(spark, sf_dir)))
    return texts, search.rrf([search.bm25(texts, query, n, ["session", "seq"])], ["session", "seq"])


def recall_filtered(spark, sf_dir):
    texts, hits = _keyword_hits(spark, sf_dir, 24, "urgent order")
    return R.hydrated(texts, hits, _order_days(spark, sf_dir), 1_000_000_000_000, 12, kind="obs").select("score", "kind", "cited", "age", "session", "seq", F.coalesce("basis", F.lit("")).alias("basis"), "text")


def recall_hybrid(spark, sf_dir):
    """Keyword and vector lanes over all texts, fused, filtered and with drift from the commits of the orders."""
    return R.recall(claims(spark, sf_dir).unionByName(spoken(spark, sf_dir)).unionByName(_commits(spark, sf_dir)), "urgent order", 1_000_000_000_000, 12, kind="obs")


def diversity_cap(spark, sf_dir):
    texts, hits = _keyword_hits(spark, sf_dir, 60)
    return search.diversity_cap(hits.join(texts, ["session", "seq"]), ["session", "seq"]).select("session", "seq", F.round("score", 9).alias("score"))


def _flat(digest: DataFrame) -> DataFrame:
    return digest.withColumn("files", F.array_join("files", "|"))


def ladder_bands(spark, sf_dir):
    first, last = _frontier(spark, sf_dir)
    per_day = V.obs_per_day(V.evidence(claims(spark, sf_dir)))
    return _flat(C.digest(spark, C.bands(first, last - 2, 10), _order_days(spark, sf_dir), _order_files(spark, sf_dir), per_day)).select("band", "start", "end", "tools", "fails", "commits", "sessions", "obs", "files")


def window_digest(spark, sf_dir):
    last = _frontier(spark, sf_dir)[1]
    spans = [s for w in ("1996", "1997-03", "q2", "w9", "1998-01-15", "1996-q1..1997-02", "2100") if (s := C.parse_window(w, last))]
    per_day = V.obs_per_day(V.evidence(claims(spark, sf_dir)))
    return _flat(C.digest(spark, spans, _order_days(spark, sf_dir), _order_files(spark, sf_dir), per_day)).select("band", "label", "start", "end", "tools", "fails", "commits", "sessions", "obs", "files")


def window_children(spark, sf_dir):
    span = C.parse_window("1997-q2", 20_000)
    per_day = V.obs_per_day(V.evidence(claims(spark, sf_dir)))
    kids = C.children(span.start, span.end) + C.children(span.start, span.start + 29) + C.children(span.start, span.start + 6)
    return _flat(C.digest(spark, kids, _order_days(spark, sf_dir), _order_files(spark, sf_dir), per_day)).select("band", "label", "start", "end", "tools", "commits", "obs", "files")


def _zoomed(spark, sf_dir) -> C.Span:
    last = now_of(spark, sf_dir) // S.DAY_MS
    return C.Span(last - 9, last - 3)


def zoom_sessions(spark, sf_dir):
    return R.overlapping(V.sessions(mechanical(spark, sf_dir)), _zoomed(spark, sf_dir)).select("session", "cwd", "commits", "start_ms", "end_ms")


def zoom_said(spark, sf_dir):
    span = C.parse_window("2024-01", 30_000)
    return R.zoom(spoken(spark, sf_dir), span)["said"]


def zoom_observations(spark, sf_dir):
    return R.zoom(claims(spark, sf_dir), C.parse_window("1997-w20", 30_000))["observations"]


def events_filtered(spark, sf_dir):
    rows = R.events(mechanical(spark, sf_dir), now_of(spark, sf_dir), session="1", kind="tool", since_days=7)
    return rows.select("session", "seq", "ts_ms", "v", "kind", X.summary().alias("summary"))


def event_summaries(spark, sf_dir):
    return mechanical(spark, sf_dir).unionByName(claims(spark, sf_dir)).select("session", "seq", "kind", X.summary().alias("summary"))


def asof_days(spark, sf_dir):
    return V.days(mechanical(spark, sf_dir).where(F.col("ts_ms") <= now_of(spark, sf_dir) - 10 * S.DAY_MS))


def asof_subjects(spark, sf_dir):
    cut = 852_076_800_000
    return V.subjects(V.evidence(claims(spark, sf_dir).where(F.col("ts_ms") <= cut))).select("subject", "support", "last_ms", "text")


def near_subjects(spark, sf_dir):
    return L.near_subjects(V.evidence(claims(spark, sf_dir)), "group 1", 4)


def session_prefix(spark, sf_dir):
    return R.find_session(V.sessions(mechanical(spark, sf_dir)), "14").select("session", "start_ms", "end_ms", "commits")


def byte_cap(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", *(F.md5(X.byte_cap(F.col("text"), n).cast("binary")).alias(f"cap{n}") for n in (3, 50, 501)))


def text_clip(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(X.clip(F.col("text"), 150).cast("binary")).alias("clipped"))


def labels(spark, sf_dir):
    now = now_of(spark, sf_dir)
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", X.age_label(now, _millis("ts")).alias("age"), X.date_label(_millis("ts")).alias("date"), X.day_label(X.day_of(_millis("ts")), now // S.DAY_MS).alias("day"), X.short_count(F.col("event_id") * 7).alias("short"), X.short_session(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("sess"))


def calendar_parts(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return _t(spark, sf_dir, "orders").select(d.alias("d")).distinct().select(F.date_format("d", "yyyy-MM-dd").alias("day"), X.iso_week(F.col("d")).alias("week"), X.iso_year(F.col("d")).alias("iso_year"), F.weekday("d").alias("weekday"), F.date_format(F.trunc("d", "MM"), "yyyy-MM-dd").alias("month"), F.date_format(F.trunc("d", "QUARTER"), "yyyy-MM-dd").alias("quarter"))


def short_paths(spark, sf_dir):
    u = F.regexp_replace("url", "^[a-z]+://", "")
    return _t(spark, sf_dir, "pages").select("page_id", X.short_path(u).alias("short"), X.place(u).alias("place"))


def claim_lint(spark, sf_dir):
    c = claims(spark, sf_dir)
    text = F.when(F.col("seq") % 5 == 0, F.concat("text", F.lit(" Earlier TODAY"))).otherwise(F.col("text"))
    return c.select("session", "seq", F.array_join(F.transform(X.lint_notes(text), lambda x: F.concat(x["phrase"], F.lit(":"), x["reason"])), ",").alias("lint"), X.is_long_claim(F.repeat(text, 6)).alias("long"))


def subject_handles(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", X.subject_handle(F.regexp_replace("p_name", " (?=[a-m])", "-"), C.COMMAND).alias("handle"))


def _iso(ms):
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def transcript_lines_a(spark, sf_dir: str) -> DataFrame:
    """(file, pos, line): the events of each user as a transcript of the first dialect; a third of the lines have a time."""
    e, k, n = _t(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("bigint"), F.col("event_id")
    kind, text = F.col("event_type"), lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    call = lambda name, **given: F.struct(F.lit("tool_use").alias("type"), text("t", n % 4).alias("id"), F.lit(name).alias("name"), F.struct(*(v.alias(c) for c, v in given.items())).alias("input"))
    block = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    user_id = F.col("user_id")
    head = lambda who: [text("s", user_id).alias("sessionId"), F.lit(who).alias("type"), F.when(n % 3 == 0, _iso(_millis("ts"))).alias("timestamp")]
    # content blocks are of several shapes: they are put into the line as text
    line = lambda who, blocks, **more: F.replace(F.to_json(F.struct(*head(who), *(v.alias(c) for c, v in more.items()), F.struct(F.lit("@").alias("content")).alias("message"))), F.lit('"@"'), F.concat(F.lit("["), F.concat_ws(",", *(F.to_json(b) for b in blocks)), F.lit("]")))
    plain = F.to_json(F.struct(*head("user"), text("/work/team", user_id % 5).alias("cwd"), F.when(n % 2 == 0, text("topic-", n % 7)).alias("gitBranch"), F.struct(text("hello ", n).alias("content")).alias("message")))
    failed = F.struct(F.lit("tool_result").alias("type"), text("t", n % 4).alias("tool_use_id"), F.lit(True).alias("is_error"))
    made = (
        F.when(kind == "signup", plain)
        .when(kind == "click", line("assistant", [block(F.repeat(F.lit("w"), (F.lit(70) + k % 20).cast("int"))), call("Grep", pattern=text("p", k))]))
        .when(kind == "error", line("user", [failed, block(text("again ", n))]))
        .when(kind == "purchase", line("assistant", [call("Bash", command=text('git commit -m "change ', n, '" && true'))], toolUseResult=F.struct(text("[main ", F.substring(F.md5(n.cast("string").cast("binary")), 1, 7), "] change").alias("stdout"))))
        .otherwise(line("assistant", [call("Edit", file_path=text("src/file", k, ".rs"))]))
    )
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(text("u", user_id).alias("file"), pos.alias("pos"), made.alias("line"))


def transcript_lines_b(spark, sf_dir: str) -> DataFrame:
    """(file, pos, line): conversations as transcripts of the second dialect, a meta line first; every turn is also a call, odd ones a commit."""
    c = _t(spark, sf_dir, "conversations")
    id_ = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    at = _iso(F.lit(1_704_067_200_000) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000)
    item = lambda kind, **fields: F.to_json(F.struct(at.alias("timestamp"), F.lit(kind).alias("type"), F.struct(*(v.alias(n) for n, v in fields.items())).alias("payload")))
    role = F.when(F.col("role") == "system", "developer").otherwise(F.col("role"))
    said = item("response_item", type=F.lit("message"), role=role, content=F.array(F.struct(F.col("text").alias("text"))))
    command = F.concat(F.when(F.col("turn") % 2 == 1, "jj describe -m turn").otherwise("ls -l "), F.col("turn").cast("string"))
    call = item("response_item", type=F.lit("function_call"), name=F.lit("shell"), arguments=F.to_json(F.struct(command.alias("cmd"))))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = c.withColumn("p", pos).select(id_.alias("file"), F.explode(F.array(F.struct((F.col("p") * 2 - 1).alias("pos"), said.alias("line")), F.struct((F.col("p") * 2).alias("pos"), call.alias("line")))).alias("x")).select("file", "x.*")
    meta = c.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(id_.alias("file"), F.lit(0).alias("pos"), item("session_meta", session_id=id_, cwd=F.concat(F.lit("/w/"), id_)).alias("line"))
    return meta.unionByName(turns)


def _told(events: DataFrame) -> DataFrame:
    what = F.concat_ws("|", "cwd", "branch", "text", "tool", "detail", F.col("ok").cast("string"), "path", "hash", "message")
    return events.select("session", "seq", "ts_ms", "kind", F.md5(what.cast("binary")).alias("what"))


def transcript_parse_a(spark, sf_dir):
    return _told(T.parse(transcript_lines_a(spark, sf_dir)))


def transcript_parse_b(spark, sf_dir):
    return _told(T.parse(transcript_lines_b(spark, sf_dir)))


def transcript_resumed(spark, sf_dir):
    """Files read on from their fifth line."""
    lines = transcript_lines_a(spark, sf_dir)
    return _told(T.parse(lines, cursors=lines.select("file").distinct().withColumn("skip", F.lit(5))))


def transcript_formats(spark, sf_dir):
    """Both dialects and files of neither: the lines of every third user are of no known form."""
    a = transcript_lines_a(spark, sf_dir)
    odd = F.substring("file", 2, 20).cast("int") % 3 == 0
    lines = a.withColumn("line", F.when(odd, F.lit('{"kind":"mystery"}')).otherwise(F.col("line"))).unionByName(transcript_lines_b(spark, sf_dir))
    return T.formats(lines).join(T.rejected(lines).withColumn("refused", F.lit(True)), "file", "left").select("file", F.coalesce("format", F.lit("-")).alias("format"), F.coalesce("refused", F.lit(False)).alias("refused"))


def transcript_final_override(spark, sf_dir):
    return _told(T.with_final_message(T.parse(transcript_lines_a(spark, sf_dir).where("file = 'u7'")), "s7", "the work is done"))


def _fresh_root(spark) -> str:
    """A folder of its own for a store, below the folder that the cluster shares."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='ledgerloom-')).rstrip('/')}/store-{uuid.uuid4().hex}"


def capture_resumed(spark, sf_dir):
    """The first lines of all transcripts are captured, then all of them from the saved cursors on, twice, and the log is compacted: the ledger is that of one parse."""
    store, lines = Store(spark, _fresh_root(spark), parts=8, views=False), transcript_lines_a(spark, sf_dir)
    L.capture_lines(store, lines.where("pos < 9"), 1, margin=3)
    for batch in (2, 2, 3):
        L.capture_lines(store, lines, batch, margin=3)
    store.compact()
    return _told(store.snapshot().view("log"))


def upsert_latest(spark, sf_dir):
    """Events written in two batches, a third of them replaced by the second: the last version stays."""
    m = mechanical(spark, sf_dir).withColumn("ingest_ord", F.col("seq"))
    log = m.withColumn("ingest_batch", F.lit(1).cast("bigint")).unionByName(m.where("seq % 48 = 0").withColumn("detail", F.concat(F.coalesce("detail", F.lit("")), F.lit(" again"))).withColumn("ingest_batch", F.lit(2).cast("bigint")))
    return L.latest(log).select("session", "seq", "kind", F.coalesce("detail", F.lit("")).alias("detail"))


def _commits(spark, sf_dir):
    """Finished orders as commit events."""
    done = _t(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return S.conform(done.select(F.col("o_custkey").cast("string").alias("session"), F.col("o_orderkey").alias("seq"), _millis("o_orderdate").alias("ts_ms"), F.lit("commit").alias("kind")))


def brief_json(spark, sf_dir):
    """The whole brief of events and claims as the contract's objects (bands without their names)."""
    sections = R.brief(mechanical(spark, sf_dir).unionByName(claims(spark, sf_dir)), now_of(spark, sf_dir))
    sections["further"] = sections["further"].drop("label", "span", "handle")
    return R.json_lines(sections)


def further(spark, sf_dir):
    last = _frontier(spark, sf_dir)[1]
    out = R.further(spark, _order_days(spark, sf_dir), _order_files(spark, sf_dir), V.obs_per_day(V.evidence(claims(spark, sf_dir))), last * S.DAY_MS)
    return _flat(out).select("band", "start", "end", "tools", "fails", "commits", "sessions", "obs", "files")


def span_labels(spark, sf_dir):
    """What bands of a week, a month and a quarter around the first and last order are called."""
    first, last = _frontier(spark, sf_dir)
    spans = [(a, b) for day in (first, last) for a, b in ((day, day), (day - 6, day), (day - 30, day), (day - 400, day))]
    rows = [(a, b, C.span_label(C.civil(a), C.civil(b))) for a, b in spans]
    return spark.createDataFrame(rows, "start bigint, end bigint, span string").distinct()


def relevant(spark, sf_dir):
    texts, hits = _keyword_hits(spark, sf_dir, 60)
    return R.relevant(texts, hits, 1_000_000_000_000).select("session", "seq", F.round("score", 9).alias("score"), "tag", "text")


def show_session(spark, sf_dir):
    """A session by the start of its name, with each of its claims."""
    shown = R.show_session(mechanical(spark, sf_dir).unionByName(claims(spark, sf_dir)), "14")
    head = shown["session"].select("session", "place", "shown_branch", "commits", "start_ms", "end_ms")
    return head.join(shown["observations"].select("session", "subject", "seq", "text"), "session", "left")


def show_event(spark, sf_dir):
    """The cited event of the least number in a session, and who cites it."""
    ledger = mechanical(spark, sf_dir).unionByName(claims(spark, sf_dir))
    seq = R.all_citations(ledger).where("session = '14'").agg(F.coalesce(F.min("seq"), F.lit(0))).first()[0]
    shown = R.show_event(ledger, "14", seq)
    return shown["event"].select("session", "seq", "kind", "ts_ms").join(shown["citers"].select("session", F.col("seq").alias("citer"), "subject"), "session", "left")


def dispatch_trail(spark, sf_dir):
    name, out = R.dispatch(claims(spark, sf_dir).unionByName(_commits(spark, sf_dir)), ["group 7"], 1_000_000_000_000)
    return out.select(F.lit(name).alias("read"), "session", "seq", "age", "cited", F.coalesce("commits_since", F.lit(-1)).alias("commits_since"), "text")


def dispatch_zoom(spark, sf_dir):
    name, out = R.dispatch(claims(spark, sf_dir), ["1997-W20"], 1_000_000_000_000)
    return out["observations"].withColumn("read", F.lit(name))


def ledger_export(spark, sf_dir):
    """Claims as the lines of the JSON export."""
    return L.event_lines(claims(spark, sf_dir))


def local_days(spark, sf_dir):
    """The end of each order's day in a zone half an hour off the others."""
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    return _t(spark, sf_dir, "orders").select(day.alias("day")).distinct().withColumn("ms", X.local_day_ms(F.col("day"), "23:59:59", "Asia/Kolkata"))


def transcript_compactions(spark, sf_dir):
    """Turns as summaries that compact what was before, in both dialects."""
    at = _iso(F.lit(1_704_067_200_000) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000)
    c = _t(spark, sf_dir, "conversations").withColumn("p", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    name = lambda x: F.concat(F.lit(x), F.col("conv_id").cast("string"))
    a = c.select(name("a").alias("file"), F.col("p").alias("pos"), F.to_json(F.struct(name("a").alias("sessionId"), F.lit("user").alias("type"), F.lit(True).alias("isCompactSummary"), at.alias("timestamp"), F.struct(F.col("text").alias("content")).alias("message"))).alias("line"))
    b = c.select(name("b").alias("file"), F.col("p").alias("pos"), F.to_json(F.struct(at.alias("timestamp"), F.lit("compacted").alias("type"), F.struct(F.col("text").alias("message")).alias("payload"))).alias("line"))
    meta = c.where("p = 1").select(name("b").alias("file"), F.lit(0).alias("pos"), F.to_json(F.struct(at.alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(name("b").alias("session_id"), F.lit("/w").alias("cwd")).alias("payload"))).alias("line"))
    return _told(T.parse(a.unionByName(b).unionByName(meta)))


_STORES: dict[tuple[str, str], Store] = {}


def revised(spark, sf_dir) -> Store:
    """All events in a store, every seventh then moved to the next day (claims to another subject and text), every eleventh taken out. Made once a session and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = Store(spark, _fresh_root(spark), parts=8)
        events = mechanical(spark, sf_dir).unionByName(spoken(spark, sf_dir)).unionByName(claims(spark, sf_dir))
        obs = F.col("kind") == "obs"
        moved = events.where("seq % 7 = 0").withColumns({
            "ts_ms": F.col("ts_ms") + S.DAY_MS, "subject": F.when(obs & (F.col("seq") % 2 == 0), F.concat("subject", F.lit(" b"))).otherwise(F.col("subject")), "text": F.when(obs, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")),
        })
        for batch in (events, moved, events.where("seq % 11 = 0").withColumn("kind", F.lit(T.GONE))):
            store.commit(batch)
        store.compact()
        _STORES[key] = store
    return _STORES[key]


def store_days(spark, sf_dir):
    return revised(spark, sf_dir).snapshot().view("days")


def store_sessions(spark, sf_dir):
    return revised(spark, sf_dir).snapshot().view("sessions")


def store_subjects(spark, sf_dir):
    now = revised(spark, sf_dir).snapshot()
    return now.view("subjects").select("subject", "support", "last_ms", "text", "cited", F.coalesce(X.basis_label(F.col("basis")), F.lit("")).alias("basis"))


def store_files(spark, sf_dir):
    now = revised(spark, sf_dir).snapshot()
    who = now.view("file_sessions").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("session")), ",").alias("sessions"))
    return now.view("day_files").join(who, "path")


def store_obs_per_day(spark, sf_dir):
    return revised(spark, sf_dir).snapshot().view("obs_per_day")


def store_keyword(spark, sf_dir):
    """BM25 from the postings of the query's terms."""
    return revised(spark, sf_dir).snapshot().keyword("revised urgent order", 12).withColumn("score", F.round("score", 6))


def store_asof(spark, sf_dir):
    """A reader of the first version after the others were committed."""
    return revised(spark, sf_dir).snapshot(1).view("obs_per_day")


def store_recall(spark, sf_dir):
    """Both lanes from the indexes, texts from the parts of the hits, drift from the stored days."""
    now = revised(spark, sf_dir).snapshot()
    hits, texts = now.search("urgent order", 24)
    return R.hydrated(texts, hits, now.view("days"), 1_000_000_000_000, 12)


def observe_claim(spark, sf_dir):
    """A new claim in a store of all claims: its number, its lint, the support of its subject and subjects named like it."""
    store = Store(spark, _fresh_root(spark), parts=8)
    store.commit(claims(spark, sf_dir))
    L.observe(store, "7", "group 1", "the first of two", 852_076_800_000)
    out = L.observe(store, "7", "group 1", "it landed earlier", 852_076_800_001, [16], ("abcdef0123", True))
    return out.select("session", "seq", "subject", "text", "support", F.array_join("lint", ",").alias("lint"), F.array_join("near", ",").alias("near"), X.basis_label(F.col("basis")).alias("basis"))


QUERIES = [
    day_digest, days_view, day_files_top4, file_sessions, sessions_summary, active_sessions, last_session, top_files, subjects_newest_wins, evidence_trail, subject_trail, commits_since, subjects_report,
    citers, obs_per_day, texts_searchable, texts_embeddable, bm25_topk, vector_topk, rrf_fused, recall_filtered, diversity_cap, ladder_bands, window_digest, window_children, zoom_sessions, zoom_said,
    zoom_observations, events_filtered, event_summaries, asof_days, asof_subjects, near_subjects, session_prefix, byte_cap, text_clip, labels, calendar_parts, short_paths, claim_lint, subject_handles,
    transcript_parse_a, transcript_parse_b, transcript_resumed, transcript_formats, transcript_final_override, capture_resumed, upsert_latest,
    recall_hybrid, brief_json, further, span_labels, relevant, show_session, show_event, dispatch_trail, dispatch_zoom, ledger_export, local_days, transcript_compactions,
    store_days, store_sessions, store_subjects, store_files, store_obs_per_day, store_keyword, store_asof, observe_claim,
]


#: The lists of the vector index have no SQL; tests hold them against brute force.
WITHOUT_SQL = [store_recall]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def without_sql() -> dict:
    return {f.__name__: f for f in WITHOUT_SQL}
