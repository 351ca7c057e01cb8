"""Transcripts, the change log, views, reads and streaming on small ledgers."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom import schema as S
from ledgerloom.operators import search
from ledgerloom.plans import reads as R
from ledgerloom.plans import timeline as C
from ledgerloom.plans import views as V
from ledgerloom.sources import ledger as L
from ledgerloom.sources import transcripts as T
from ledgerloom.streaming.store import Store

HOUR = 3_600_000


def line(kind, content, at, **more):
    return json.dumps({"sessionId": "sess-a", "type": kind, "timestamp": f"2026-08-10T10:{at:02d}:00.000Z", "message": {"content": content}} | more)


def dialect_a():
    tool = lambda i, name, **given: {"type": "tool_use", "id": i, "name": name, "input": given}
    fail = lambda i: {"type": "tool_result", "tool_use_id": i, "is_error": True}
    long = "w" * 79
    return [
        line("user", "please do it", 0, cwd="/work/team/app", gitBranch="main"),
        "",
        "not json {",
        json.dumps({"unknown": 1}),
        line("assistant", [{"type": "text", "text": long}, {"type": "text", "text": long + "é"}, tool("t1", "Bash", command='git commit -m "fix: it" && ls'), tool("t2", "Edit", file_path="src/a/b.rs", new="x")], 4, toolUseResult={"stdout": "[main abc1234] fix"}),
        line("user", [fail("t1"), fail("t9"), {"type": "text", "text": "next"}], 5),
        json.dumps({"type": "assistant", "message": {"content": [tool("t3", "Grep", pattern="p", a=1), tool("t4", "Edit", file_path="one"), tool("t5", "Write", file_path="two")]}}),
        json.dumps({"type": "user", "isCompactSummary": True, "timestamp": "2026-08-10T10:07:00.000Z", "message": {"content": "so far"}}),
        line("assistant", "a plain string is not kept", 8),
        line("assistant", [{"type": "text", "text": "x" * 20}] * 15, 9),
        line("assistant", [{"type": "text", "text": "All of it is done now, and this remark is certainly longer than eighty bytes in all."}], 10),
        line("assistant", [tool("t6", "Bash", command="git commit --message x")], 11),
    ]


def write(tmp_path, name, lines):
    p = tmp_path / f"{name}.jsonl"
    p.write_text("\n".join(lines))
    return str(p)


def parsed(spark, path, **more):
    return {r.seq: r for r in T.parse(T.read_lines(spark, path), **more).collect()}


def test_dialect_a(spark, tmp_path):
    got = parsed(spark, write(tmp_path, "a", dialect_a()))
    kinds = {s: r.kind for s, r in got.items()}
    assert kinds == {
        0: "meta", 2: "user", 67: "said", 68: "tool", 69: "tool", 78: "commit", 79: "file", 84: "user", 98: "tool", 99: "tool", 100: "tool", 111: "file",
        113: "compacted", 114: "compact", 162: "final", 178: "tool", 190: "commit",
    }
    assert (got[0].cwd, got[0].branch, got[2].text) == ("/work/team/app", "main", "please do it")
    assert (got[68].ok, got[68].detail) == (False, 'git commit -m "fix: it" && ls') and got[69].ok and got[69].detail == "src/a/b.rs"
    assert (got[78].hash, got[78].message) == ("abc1234", "fix: it") and got[190].message == "essage"
    assert got[98].detail == '{"a":1,"pattern":"p"}' and got[111].path == "two" and got[114].text == "so far"
    assert got[98].ts_ms == got[84].ts_ms  # carried forward
    assert got[162].text.startswith("All of it") and {r.session for r in got.values()} == {"sess-a"}


@pytest.mark.parametrize("skip", [1, 4, 6, 10])
def test_cursor_gives_a_suffix(spark, tmp_path, skip):
    path = write(tmp_path, "a", dialect_a())
    cursors = spark.createDataFrame([("a", skip)], "file string, skip long")
    whole, part = parsed(spark, path), parsed(spark, path, cursors=cursors)
    assert part == {s: r for s, r in whole.items() if s >= skip * 16}


def dialect_b():
    item = lambda **p: json.dumps({"timestamp": "2026-08-11T08:00:00.000Z", "type": "response_item", "payload": p})
    say = lambda role, *texts: item(type="message", role=role, content=[{"type": "t", "text": t} for t in texts])
    return [
        json.dumps({"timestamp": "2026-08-11T08:00:00.000Z", "type": "session_meta", "payload": {"session_id": "sess-b", "cwd": "/w"}}),
        say("user", "hello", "there"),
        item(type="reasoning", text="hidden"),
        say("developer", "injected"),
        item(type="function_call", name="shell", arguments=json.dumps({"cmd": "jj describe -m 'all done' x"})),
        item(type="custom_tool_call", name="patch", arguments="not json"),
        json.dumps({"timestamp": "2026-08-11T08:01:00.000Z", "type": "compacted", "payload": {"message": " ", "replacement_history": [{"content": [{"text": "kept"}]}]}}),
        say("assistant", "the end", "z" * 100),
    ]


def test_dialect_b_and_rejection(spark, tmp_path):
    got = parsed(spark, write(tmp_path, "b", dialect_b()))
    assert {s: r.kind for s, r in got.items()} == {2: "meta", 18: "user", 66: "tool", 67: "commit", 82: "tool", 98: "compacted", 99: "compact", 114: "final"}
    assert (got[18].text, got[66].detail, got[67].message, got[67].hash, got[82].detail, got[99].text, got[114].text) == ("hello there", "jj describe -m 'all done' x", "all done", "", "not json", "kept", "the end")
    bad = write(tmp_path, "odd", ['{"kind":"mystery"}'] * 3)
    lines = T.read_lines(spark, [bad, write(tmp_path, "b", dialect_b())])
    assert [r.file for r in T.rejected(lines).collect()] == ["odd"]
    assert T.parse(T.read_lines(spark, bad), fallback="x").count() == 0


def test_large_files_are_read_by_splits(spark, tmp_path):
    lines = [f'{{"n": {i}, "pad": "{"x" * (i % 70)}é"}}' for i in range(3000)] + ["", "last, without an end"]
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        got = T.read_lines(spark, str(tmp_path / "*.jsonl"))
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        rows_ = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert rows_ == [(name, i, x) for name in ("a", "b") for i, x in enumerate(lines)]


@pytest.mark.parametrize("margin", [0])
def test_resumed_captures_need_few_lines(spark, tmp_path, sf, margin):
    """Three captures of growing transcripts leave the ledger of one parse; what is kept for the next doesn't grow with the lines."""
    from ledgerloom.plans import catalog

    lines = catalog.transcript_lines_a(spark, sf).unionByName(catalog.transcript_lines_b(spark, sf)).where("file in ('u3', 'u7', 'c1', 'c4')")
    lines = spark.createDataFrame(lines.collect(), "file string, pos int, line string")
    store = Store(spark, (tmp_path / "s").as_uri(), parts=2, views=False)
    for upto in (4, 12, 10_000):
        L.capture_lines(store, lines.where(F.col("pos") < upto), margin=margin)
    whole = T.parse(lines)
    want = sorted(map(str, whole.select(*S.COLUMNS).collect()))
    assert sorted(map(str, store.snapshot().view("log").select(*S.COLUMNS).collect())) == want
    kept = {r.file: r["count"] for r in store.snapshot().view("kept").groupBy("file").count().collect()}
    assert max(kept.values()) <= 8 + margin + 12 and sum(kept.values()) < lines.count()


def test_final_message_from_outside(spark, tmp_path):
    events = T.parse(T.read_lines(spark, write(tmp_path, "a", dialect_a())))
    got = T.with_final_message(events, "sess-a", "closing").where("kind = 'final'").collect()
    assert [(r.seq, r.text) for r in got] == [(S.HOOK_FINAL_SEQ, "closing")] and got[0].ts_ms == events.agg(F.max("ts_ms")).first()[0]
    assert T.with_final_message(events, "sess-a", "  ").count() == events.count()


def logged(store):
    return sorted(map(str, store.snapshot().view("log").collect()))


def test_capture_is_idempotent(spark, tmp_path):
    path, store = write(tmp_path, "a", dialect_a()), Store(spark, (tmp_path / "root").as_uri(), parts=4, views=False)
    L.capture(store, path, 1)
    first = logged(store)
    L.capture(store, path, 2)
    L.capture(store, path, 2)
    assert logged(store) == first and store.snapshot().version == 2


def event(session, seq, ts, kind, **p):
    return {"session": session, "seq": seq, "ts_ms": ts, "kind": kind} | p


def rows(spark, events):
    return S.conform(spark.createDataFrame([tuple(e.get(c) for c in S.COLUMNS if c != "v") for e in events], ", ".join(f"{n} {t}" for n, t in S.COLUMNS.items() if n != "v")))


TOPICS = ["harbour", "orchard", "kiln", "lantern"]


def working_days(seed=20, sessions=5):
    """Sessions of random length over some days: calls that mostly succeed, files, and claims on a few topics."""
    rnd, out = random.Random(seed), []
    for name in (f"{0xFA0000 + i:x}" for i in range(sessions)):
        at, claims = rnd.randrange(5 * 24 * 60) * 60_000, 0
        for n in range(rnd.randint(9, 31)):
            at += rnd.randrange(1, 200) * 60_000
            kind = rnd.choice(("tool", "tool", "tool", "file", "obs", "user"))
            if kind == "tool":
                out.append(event(name, 16 * n, at, "tool", tool=rnd.choice(("Look", "Run")), detail=f"step {n}", ok=rnd.random() < 0.7))
            elif kind == "file":
                out.append(event(name, 16 * n, at, "file", path=f"pkg/part{rnd.randrange(3)}/unit{rnd.randrange(4)}.py"))
            elif kind == "user":
                out.append(event(name, 16 * n, at, "user", text=f"request {n} of {name}"))
            else:
                topic = rnd.choice(TOPICS)
                out.append(event(name, S.FIRST_OBS_SEQ + claims, at, "obs", subject=topic, text=f"{topic} holds since step {n}", derived_from=[16 * rnd.randrange(n + 1)]))
                claims += 1
    return out


def expected(events):
    """Days, newest claim and support of each subject, and end of each session, in plain Python."""
    days, newest, support, end = {}, {}, Counter(), {}
    for e in events:
        if e["kind"] in ("meta", "tool", "commit", "final"):
            end[e["session"]] = max(end.get(e["session"], 0), e["ts_ms"])
        if e["kind"] == "tool":
            calls, fails = days.get(e["ts_ms"] // S.DAY_MS, (0, 0))
            days[e["ts_ms"] // S.DAY_MS] = (calls + 1, fails + (not e["ok"]))
        if e["kind"] == "obs":
            support[e["subject"]] += 1
            newest[e["subject"]] = max(newest.get(e["subject"], ()), (e["ts_ms"], e["seq"], e["session"], e["text"]))
    return days, {k: (support[k], v[3]) for k, v in newest.items()}, end


@pytest.mark.parametrize("seed", range(3))
def test_views_equal_plain_python(spark, seed):
    events = working_days(seed)
    for part in (events, random.Random(seed).sample(events, len(events) // 3), []):
        days, subjects, end = expected(part)
        ledger = rows(spark, part)
        assert {r.day: (r.tools, r.fails) for r in V.days(ledger).where("tools > 0").collect()} == days
        assert {r.subject: (r.support, r.text) for r in V.subjects(V.evidence(ledger)).collect()} == subjects
        assert {r.session: r.end_ms for r in V.sessions(ledger).collect()} == end


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8, 1.0])
def test_asof_equals_views_of_what_was_known(spark, share):
    events = working_days(4)
    at = int(share * max(e["ts_ms"] for e in events))
    known = [e for e in events if e["ts_ms"] <= at]
    got = {r.subject: r.text for r in V.subjects(V.evidence(rows(spark, events).where(F.col("ts_ms") <= at))).collect()}
    assert got == {k: text for k, (_, text) in expected(known)[1].items()}


def test_revision_hides_the_old_text(spark, tmp_path):
    store = Store(spark, (tmp_path / "log").as_uri(), parts=4)
    store.commit(rows(spark, [event("s", 1, 5, "obs", subject="x", text="the zebra rule"), event("s", 2, 5, "obs", subject="y", text="a zebra too"), event("t", 3, 5, "obs", subject="z", text="the zebra rule")]))
    store.commit(rows(spark, [event("s", 1, 9, "obs", subject="x", text="some heron habit"), event("t", 3, 5, "gone")]))
    now = store.snapshot()
    ledger, vector = now.view("log"), search.embed_query("the zebra rule", spark)
    assert [r.seq for r in now.keyword("zebra", 5).collect()] == [2]
    near = {r.seq: r.score for r in now.nearest(vector, 9).collect()}
    assert set(near) == {1, 2} and near[2] > 0.3 > near[1]  # the control keeps a word of the old text, the revised one doesn't
    before = {r.seq: round(r.score, 6) for r in store.snapshot(1).nearest(vector, 9).collect()}
    assert before[1] == before[3] == 1.0  # a reader of the version before still finds both
    assert V.subjects(V.evidence(ledger)).where("subject = 'x'").first().text == "some heron habit"
    assert [r.subject for r in R.asof(ledger, 6)["subjects"].collect()] == ["y"]


def test_ties_anchors_and_drift(spark):
    basis = {"commit": "0123456789abcdef", "dirty": True}
    day = S.DAY_MS
    ledger = rows(spark, [event("s", 1, 9 * day, "obs", subject="a", text="old"), event("s", 2, 9 * day, "obs", subject="a", text="new", basis=basis, derived_from=[1]), event("t", 1, 12 * day, "obs", subject="b", text="late", basis=basis), event("t", 2, 99 * day, "obs", subject="c", text="last")])
    days = spark.createDataFrame([(10, 3), (11, 2), (12, 5)], "day long, commits long")
    claims = spark.createDataFrame([(d, d * day) for d in (9, 10, 12, 99)], "d long, ts_ms long")
    assert {r.d: r.since for r in R.commits_since(claims, days).collect()} == {9: 10, 10: 7, 12: 0, 99: 0}
    report = {r.subject: r for r in R.subjects_report(V.subjects(V.evidence(ledger)), days, 100 * day).collect()}
    assert (report["a"].text, report["a"].basis, report["a"].cited) == ("new", "@01234567+ · ~10 commits since", True)
    assert report["b"].basis == "@01234567+" and report["c"].basis is None
    assert [r.seq for r in R.citers(ledger, 1).collect()] == [2]


def test_brief_zoom_recall_and_dispatch(spark):
    events = working_days(6)
    late = max(e["ts_ms"] for e in events) + HOUR
    events += [event("fa0000", 7001, late - 3 * HOUR, "meta", cwd="/w/app", branch="main"), event("fa0001", 7002, late, "final", text="the closing words")]
    ledger, now = rows(spark, events), late + HOUR // 2
    days, subjects, end = expected(events)
    got = R.brief(ledger, now, "closing words")
    assert got["days"].count() == 3 and got["days"].first().label in ("today", "yesterday")
    assert [r.session for r in got["active"].collect()] == ["fa0001"]
    assert got["last_session"].first().final_msg == "the closing words" and got["relevant"].first().text == "the closing words"
    assert {r.subject for r in got["subjects"].collect()} <= set(subjects)
    hits = R.recall(ledger, "harbour holds", now, limit=3, kind="obs").collect()
    assert len(hits) == 3 and all(h.kind == "obs" for h in hits) and "harbour" in hits[0].text
    with pytest.raises(ValueError):
        R.recall(ledger, "  ", now)
    zoom = R.zoom(ledger, C.Span(0, late // S.DAY_MS))
    claims = sum(e["kind"] == "obs" for e in events)
    assert zoom["digest"].first().tools == sum(t for t, _ in days.values()) and zoom["observations"].count() == claims and zoom["sessions"].count() == len(end)
    names = [R.dispatch(ledger, w, now)[0] for w in ([], ["1970-01-02"], ["fa0000"], ["orchard"], ["closing", "words"])]
    assert names == ["brief", "zoom", "show", "trail", "recall"]
    assert R.show_session(ledger, "fa0000")["observations"].count() == sum(e["kind"] == "obs" and e["session"] == "fa0000" for e in events)


def test_claim_takes_the_next_number(spark):
    events = working_days(7)
    made = sum(e["kind"] == "obs" and e["session"] == "fa0001" for e in events)
    ledger = rows(spark, events)
    row = L.claim(ledger, "fa0001", "kiln", "it landed today", 5, [1, 2], ("abc", False)).first()
    assert (row.seq, row.lint, row.derived_from, row.basis.commit) == (S.FIRST_OBS_SEQ + made, ["today", "landed"], [1, 2], "abc")
    assert L.claim(ledger, "new", "kiln", "x", 5).first().seq == S.FIRST_OBS_SEQ
    assert [r.subject for r in L.near_subjects(V.evidence(ledger), "kilns").collect()] == ["kiln"]


def test_observe_appends_with_support_and_near_subjects(spark, tmp_path):
    store = Store(spark, (tmp_path / "root").as_uri(), parts=4)
    store.commit(rows(spark, [event("fa0000", S.FIRST_OBS_SEQ, 5, "obs", subject="kilns", text="two of them"), event("fa0001", S.FIRST_OBS_SEQ, 6, "obs", subject="kiln", text="warm")]))
    got = L.observe(store, "fa0000", "kiln", "it landed earlier", 9, [16]).first()
    assert (got.seq, got.support, got.near, got.lint) == (S.FIRST_OBS_SEQ + 1, 2, ["kilns"], ["earlier", "landed"])
    assert [tuple(n) for n in got.notes] == [("earlier", "time-deictic"), ("landed", "status-log")]
    L.observe(store, "fa0000", "kiln", "another", 9)  # claims don't share a number
    ledger = store.snapshot().view("log")
    assert ledger.where("kind = 'obs'").count() == 4
    assert L.contains(ledger, "fa0000", S.FIRST_OBS_SEQ + 2) and not L.contains(ledger, "fa0000", S.FIRST_OBS_SEQ + 3)


def test_compaction_keeps_the_ledger_and_cursors(spark, tmp_path):
    store, path = Store(spark, (tmp_path / "root").as_uri(), parts=4, views=False), write(tmp_path, "a", dialect_a())
    for batch in (1, 2, 3):
        L.capture(store, path, batch)
    store.commit(rows(spark, [event("sess-a", 2, 7, "user", text="said otherwise")]))
    state = lambda: (logged(store), L.cursors(store.snapshot(), 0).collect())
    was = state()
    store.compact()
    assert state() == was and all(len(f) == 1 for t in store.snapshot().manifest["tables"].values() for f in t.values())


def test_capture_takes_a_final_message(spark, tmp_path):
    store = Store(spark, (tmp_path / "root").as_uri(), parts=4, views=False)
    assert L.capture(store, write(tmp_path, "a", dialect_a()), 1, final=("sess-a", "closing")).count() == 0
    got = store.snapshot().view("log").where("kind = 'final'").collect()
    assert [(r.seq, r.text) for r in got] == [(S.HOOK_FINAL_SEQ, "closing")]


def test_json_export(spark):
    first = next(e for e in working_days() if e["kind"] == "tool")
    got = json.loads(L.event_lines(rows(spark, [first])).first().value)
    assert set(got) == {"session", "seq", "ts_ms", "v", "event"} and got["event"]["kind"] == "tool"


def test_stream_keeps_views_current(spark, tmp_path):
    inbox, store = tmp_path / "in", Store(spark, (tmp_path / "root").as_uri(), parts=4)
    events = working_days(8)
    half = len(events) // 2
    rows(spark, events[:half]).write.parquet(f"{inbox}/1")
    stream = lambda: spark.readStream.schema(S.EVENT_DDL).parquet(f"{inbox}/*")
    run = lambda: store.start(stream(), (tmp_path / "ck").as_uri()).awaitTermination()
    run()
    old = next(e for e in events[:half] if e["kind"] == "obs")
    rows(spark, events[half:] + [old | {"subject": "elsewhere", "text": "moved"}]).write.parquet(f"{inbox}/2")
    run()
    now = store.snapshot()
    ledger = now.view("log")
    for name, want in (("days", V.days(ledger)), ("subjects", V.subjects(V.evidence(ledger))), ("sessions", V.sessions(ledger))):
        assert sorted(map(str, now.view(name).select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert now.view("subjects").where("subject = 'elsewhere'").count() == 1
