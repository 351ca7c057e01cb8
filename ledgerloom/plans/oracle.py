"""DuckDB SQL for the registered queries, written apart from the DataFrame code."""

from __future__ import annotations

WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


def _squeeze(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g')"


def _clip(c: str, n: int) -> str:
    return f"(CASE WHEN length({_squeeze(c)}) <= {n} THEN {_squeeze(c)} ELSE substr({_squeeze(c)}, 1, {n}) || '…' END)"


def _cap(c: str, n: int) -> str:
    """Longest run of whole characters within n bytes."""
    return f"(CASE WHEN strlen({c}) <= {n} THEN {c} ELSE substr({c}, 1, (SELECT coalesce(max(i), 0) FROM range(greatest({n} // 4, 0), {n} + 1) r(i) WHERE strlen(substr({c}, 1, CAST(i AS BIGINT))) <= {n})) END)"


def _short_path(c: str) -> str:
    return f"(CASE WHEN len(string_split({c}, '/')) >= 3 THEN '…/' || string_split({c}, '/')[-2] || '/' || string_split({c}, '/')[-1] ELSE {c} END)"


def _age(now: str, ts: str) -> str:
    gap = f"greatest(({now}) - ({ts}), 0)"
    return f"(CASE WHEN {gap} < 3600000 THEN '<1h' WHEN {gap} < 86400000 THEN CAST({gap} // 3600000 AS VARCHAR) || 'h' ELSE CAST({gap} // 86400000 AS VARCHAR) || 'd' END)"


def _day(ts: str) -> str:
    return f"CAST(floor(({ts}) / 86400000.0) AS BIGINT)"


BASIS = "'@' || substr(commit, 1, 8) || CASE WHEN dirty THEN '+' ELSE '' END"
MECH = """
mech AS (
  SELECT CAST(user_id AS VARCHAR) AS session, event_id * 16 AS seq, epoch_us(ts) // 1000 AS ts_ms, event_id, event_type AS et, user_id,
         CASE event_type WHEN 'signup' THEN 'meta' WHEN 'click' THEN 'tool' WHEN 'error' THEN 'tool' WHEN 'purchase' THEN 'commit' ELSE 'file' END AS kind,
         CASE WHEN event_type = 'signup' THEN '/work/team' || (user_id % 5) || '/app' || (event_id % 3) END AS cwd,
         CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'topic-' || (event_id % 7) END AS branch,
         'tool' || (event_id % 4) AS tool, 'run  step ' || CAST(props ->> '$.k' AS BIGINT) AS detail, event_type <> 'error' AS ok,
         CASE WHEN event_type = 'view' THEN 'src/mod' || (CAST(props ->> '$.k' AS BIGINT) % 6) || '/file' || CAST(props ->> '$.k' AS BIGINT) || '.rs' END AS path
  FROM events),
now AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events),
days AS (
  SELECT CAST(floor(ts_ms / 86400000.0) AS BIGINT) AS day, count(*) FILTER (kind = 'tool') AS tools, count(*) FILTER (kind = 'tool' AND NOT ok) AS fails,
         count(*) FILTER (kind = 'commit') AS commits, count(*) FILTER (kind = 'meta') AS sessions, count(*) FILTER (kind = 'file') AS touches
  FROM mech GROUP BY 1),
day_files AS (SELECT CAST(floor(ts_ms / 86400000.0) AS BIGINT) AS day, path, count(*) AS n FROM mech WHERE kind = 'file' GROUP BY 1, 2)"""
SPOKEN = f"""
turns AS (SELECT *, max(turn) OVER (PARTITION BY conv_id, role) AS last FROM conversations),
spoken0 AS (
  SELECT 'c' || conv_id AS session, turn * 16 + 2 AS seq, 1704067200000 + conv_id * 3600000 + turn * 60000 AS ts_ms, text AS t,
         CASE WHEN role = 'user' THEN 'user' WHEN turn = last THEN 'final' WHEN strlen(text) >= 80 THEN 'said' END AS kind
  FROM turns WHERE role <> 'system'),
spoken AS (
  SELECT session, seq, ts_ms, kind, CASE kind WHEN 'user' THEN {_cap("t", 2048)} WHEN 'final' THEN {_cap("t", 8192)} ELSE {_cap("t", 1200)} END AS text
  FROM spoken0 WHERE kind IS NOT NULL)"""
CLAIMS = """
claims AS (
  SELECT CAST(o_custkey AS VARCHAR) AS session, 2147483648 + o_orderkey AS seq, epoch_us(o_orderdate) // 1000 AS ts_ms, 'group ' || (o_custkey % 200) AS subject,
         o_orderpriority || ' order shipped in status ' || o_orderstatus || ' no ' || o_orderkey AS text, o_orderkey % 3 = 0 AS cited,
         CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey * 16 % 4096, o_orderkey * 16 % 4096 + 16] ELSE [] END AS derived,
         CASE WHEN o_orderkey % 2 = 0 THEN md5(CAST(o_orderkey AS VARCHAR)) END AS commit, o_orderkey % 4 = 0 AS dirty
  FROM orders),
odays AS (
  SELECT CAST(floor(epoch_us(o_orderdate) // 1000 / 86400000.0) AS BIGINT) AS day, count(*) AS tools, count(*) FILTER (o_orderstatus = 'F') AS fails,
         count(*) FILTER (o_orderstatus = 'O') AS commits, count(*) FILTER (o_orderstatus = 'P') AS sessions FROM orders GROUP BY 1),
ofiles AS (SELECT CAST(floor(epoch_us(o_orderdate) // 1000 / 86400000.0) AS BIGINT) AS day, 'src/area/' || o_orderpriority AS path, count(*) AS n FROM orders GROUP BY 1, 2),
operday AS (SELECT CAST(floor(ts_ms / 86400000.0) AS BIGINT) AS day, count(*) AS obs FROM claims GROUP BY 1)"""
SUBJ = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts_ms DESC, seq DESC, session DESC) AS r, count(*) OVER (PARTITION BY subject) AS support FROM claims),
subj AS (SELECT subject, support, ts_ms AS last_ms, text, cited, coalesce({BASIS}, '') AS basis FROM ranked WHERE r = 1)"""


def _since(day: str) -> str:
    return f"(SELECT coalesce(CAST(sum(commits) AS BIGINT), 0) FROM odays WHERE odays.day > {day})"


def _sessions(src: str) -> str:
    return f"""
sess AS (
  SELECT session, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, coalesce(arg_max(cwd, (ts_ms, seq)) FILTER (kind = 'meta'), '') AS cwd,
         arg_max_null(branch, (ts_ms, seq)) FILTER (kind = 'meta') AS branch,
         coalesce(arg_max(text, (ts_ms, seq)) FILTER (kind = 'final'), '') AS final_msg, count(*) FILTER (kind = 'commit') AS commits
  FROM {src} a WHERE kind IN ('meta', 'final', 'commit', 'tool') GROUP BY session)"""


def _session_rows(parts: str) -> str:
    return "allrows AS (" + parts + ")"


M_ROWS = "SELECT session, seq, ts_ms, kind, cwd, branch, CAST(NULL AS VARCHAR) AS text FROM mech"
S_ROWS = "SELECT session, seq, ts_ms, kind, NULL AS cwd, NULL AS branch, text FROM spoken"
TEXTS = """
texts AS (
  SELECT session, seq, 'obs' AS kind, ts_ms, cited, text, commit, dirty FROM claims
  UNION ALL SELECT session, seq, kind, ts_ms, TRUE, text, NULL, NULL FROM spoken WHERE regexp_replace(text, '\\s', '', 'g') <> '')"""
WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25(rel: str, keys: str, query: list[str]) -> str:
    """(keys, score) of all rows of a relation that hold a term."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(query))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(query)))
    part = " + ".join(f"ln(1 + (N - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(len(query)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(query)))
    return f"""(WITH a AS (SELECT {keys}, {WORDS.format("text")} AS w FROM {rel}), b AS (SELECT {keys}, len(w) AS dl, {tf} FROM a),
      c AS (SELECT count(*) AS N, avg(dl) AS avgdl, {df} FROM b) SELECT {keys}, {part} AS score FROM b, c WHERE {some})"""


COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


def _digest(windows: str, cols: str) -> str:
    """A digest of windows (band, label, start, end)."""
    return f"""
  SELECT {cols} FROM (
    SELECT band, label, w.start, w."end", (SELECT CAST(coalesce(sum(tools), 0) AS BIGINT) FROM odays WHERE day BETWEEN w.start AND w."end") AS tools,
      (SELECT CAST(coalesce(sum(fails), 0) AS BIGINT) FROM odays WHERE day BETWEEN w.start AND w."end") AS fails,
      (SELECT CAST(coalesce(sum(commits), 0) AS BIGINT) FROM odays WHERE day BETWEEN w.start AND w."end") AS commits,
      (SELECT CAST(coalesce(sum(sessions), 0) AS BIGINT) FROM odays WHERE day BETWEEN w.start AND w."end") AS sessions,
      (SELECT CAST(coalesce(sum(obs), 0) AS BIGINT) FROM operday WHERE day BETWEEN w.start AND w."end") AS obs,
      coalesce((SELECT string_agg({_short_path("path")}, '|' ORDER BY n DESC, path) FROM (
        SELECT path, sum(n) AS n, row_number() OVER (ORDER BY sum(n) DESC, path) AS r, sum(sum(n)) OVER () AS total FROM ofiles WHERE day BETWEEN w.start AND w."end" GROUP BY path)
        WHERE r <= 2 AND n * 4 >= total), '') AS files
    FROM ({windows}) w)"""


DATE = "CAST(date_diff('day', DATE '1970-01-01', {}) AS BIGINT)"
LAST = "(SELECT max(day) FROM odays)"


def _bands(budget: int, frontier: str) -> str:
    """The walk back from the frontier as a recursive query: weeks, months, quarters, years."""
    back = f"""CASE WHEN {{i}} + 1 >= {budget} THEN lo
        ELSE greatest(lo, {DATE.format("date_trunc(CASE WHEN {i} < 2 THEN 'week' WHEN {i} < 4 THEN 'month' WHEN {i} < 6 THEN 'quarter' ELSE 'year' END, DATE '1970-01-01' + CAST({e} AS INTEGER))")}) END"""
    return f"""
ends AS (SELECT min(day) AS lo, {frontier} - 1 AS e FROM odays),
walk AS (
  SELECT 0 AS band, {back.format(i="0", e="e")} AS start, e AS "end", lo FROM ends WHERE e >= lo
  UNION ALL SELECT band + 1, {back.format(i="(band + 1)", e="(start - 1)")}, start - 1, lo FROM walk WHERE start > lo)"""


def _with(*parts: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + body


_SUMMARY_MECH = f"""CASE kind WHEN 'meta' THEN {_clip("cwd", 150)} || ' ' || coalesce(branch, '') WHEN 'tool' THEN tool || CASE WHEN ok THEN '' ELSE ' FAILED' END || ' ' || {_clip("detail", 150)}
  WHEN 'file' THEN {_clip("path", 150)} ELSE substr(md5(CAST(event_id AS VARCHAR)), 1, 8) || ' change ' || event_id END"""
_LINTED = "CASE WHEN seq % 5 = 0 THEN text || ' Earlier TODAY' ELSE text END"
_DAYS1970 = "DATE '1970-01-01' + CAST({} AS INTEGER)"

ORACLE = {
    "days_view": _with(MECH, body="SELECT * FROM days"),
    "day_digest": _with(MECH, body=f"""
      SELECT day, CASE t - day WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE (t - day) || 'd ago' END AS label, tools, fails, commits, sessions,
        coalesce((SELECT string_agg({_short_path("path")}, '|' ORDER BY n DESC, path) FROM (SELECT * FROM day_files f WHERE f.day = days.day ORDER BY n DESC, path LIMIT 4)), '') AS files
      FROM days, (SELECT {_day("now")} AS t FROM now) ORDER BY day DESC LIMIT 3"""),
    "day_files_top4": _with(MECH, body="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, path) AS r FROM day_files) WHERE r <= 4"),
    "file_sessions": _with(MECH, body="SELECT path, string_agg(DISTINCT session, ',' ORDER BY session) AS sessions FROM mech WHERE kind = 'file' GROUP BY path"),
    "sessions_summary": _with(MECH, SPOKEN, _session_rows(M_ROWS + " UNION ALL " + S_ROWS), _sessions("allrows"), body="SELECT * FROM sess"),
    "active_sessions": _with(MECH, _session_rows(M_ROWS), _sessions("allrows"), body=f"""
      SELECT session, end_ms, string_split(cwd, '/')[-1] AS "where", {_age("now", "end_ms")} AS age, commits FROM sess, now WHERE greatest(now - end_ms, 0) < 3600000 ORDER BY end_ms DESC, session LIMIT 6"""),
    "last_session": _with(SPOKEN, _session_rows(S_ROWS), _sessions("allrows"), body=f"SELECT {_age('1800000000000', 'end_ms')} AS age, branch, final_msg FROM sess WHERE final_msg <> '' ORDER BY end_ms DESC, session LIMIT 1"),
    "top_files": _with(MECH, body=f"""
      SELECT {_short_path("path")} AS path, touches, (SELECT string_agg(DISTINCT substr(session, 1, 8), ',' ORDER BY substr(session, 1, 8)) FROM mech m WHERE m.path = b.path) AS sessions
      FROM (SELECT path, CAST(sum(n) AS BIGINT) AS touches FROM day_files WHERE day IN (SELECT day FROM days ORDER BY day DESC LIMIT 3) GROUP BY path ORDER BY touches DESC, path LIMIT 5) b"""),
    "subjects_newest_wins": _with(CLAIMS, SUBJ, body="SELECT * FROM subj"),
    "evidence_trail": _with(CLAIMS, body=f"SELECT subject, session, seq, ts_ms, text, cited, coalesce({BASIS}, '') AS basis FROM claims"),
    "subject_trail": _with(CLAIMS, body=f"""
      SELECT session, seq, {_age("1000000000000", "ts_ms")} AS age, cited, CASE WHEN commit IS NULL THEN -1 ELSE {_since(_day("ts_ms"))} END AS commits_since, text FROM claims WHERE subject = 'group 7'"""),
    "commits_since": _with(CLAIMS, SUBJ, body=f"SELECT subject, last_ms AS ts_ms, {_since(_day('last_ms'))} AS since FROM subj"),
    "subjects_report": _with(CLAIMS, SUBJ, body=f"""
      SELECT subject, support, cited, {_age("1000000000000", "last_ms")} AS age, text,
        CASE WHEN basis = '' THEN '' WHEN since > 0 THEN basis || ' · ~' || since || ' commits since' ELSE basis END AS basis, last_ms, 'ledger recall --subject "' || subject || '"' AS handle
      FROM (SELECT *, {_since(_day("last_ms"))} AS since FROM subj)"""),
    "citers": _with(MECH, CLAIMS, body="""
      SELECT e.session, e.seq, e.kind, c.citer FROM (SELECT session, seq, kind FROM mech UNION ALL SELECT session, seq, 'obs' FROM claims) e
      JOIN (SELECT session, seq AS citer, unnest(derived) AS seq FROM claims) c ON e.session = c.session AND e.seq = c.seq"""),
    "obs_per_day": _with(CLAIMS, body="SELECT * FROM operday"),
    "texts_searchable": _with(CLAIMS, SPOKEN, TEXTS, body="SELECT session, seq, kind, ts_ms, cited, md5(text) AS digest FROM texts"),
    "texts_embeddable": _with(CLAIMS, SPOKEN, TEXTS, body="SELECT kind, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM texts WHERE kind <> 'said' AND (kind <> 'user' OR strlen(text) <= 400) GROUP BY kind"),
    "vector_topk": f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {COS} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10",
    "recall_filtered": _with(CLAIMS, SPOKEN, TEXTS, body=f"""
      SELECT round(score, 3) AS score, kind, cited, {_age("1000000000000", "ts_ms")} AS age, substr(session, 1, 8) AS session, seq,
        coalesce(CASE WHEN kind = 'obs' THEN {BASIS} || CASE WHEN {_since(_day("ts_ms"))} > 0 THEN ' · ~' || {_since(_day("ts_ms"))} || ' commits since' ELSE '' END END, '') AS basis, text
      FROM (SELECT session, seq, 1 / (60.0 + row_number() OVER (ORDER BY score DESC, session, seq)) AS score FROM {_bm25("texts", "session, seq", ["order", "urgent"])} ORDER BY score DESC LIMIT 24)
      JOIN texts USING (session, seq) WHERE kind = 'obs' ORDER BY score DESC, session, seq LIMIT 12"""),
    "diversity_cap": _with(CLAIMS, SPOKEN, TEXTS, body=f"""
      SELECT session, seq, round(score, 9) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, seq) AS nth FROM (
          SELECT session, seq, 1 / (60.0 + row_number() OVER (ORDER BY score DESC, session, seq)) AS score FROM {_bm25("texts", "session, seq", ["of", "order", "the", "urgent"])} ORDER BY score DESC LIMIT 60))
      WHERE nth <= 2 ORDER BY score DESC, session, seq LIMIT 6"""),
    "ladder_bands": _with(CLAIMS, _bands(10, f"({LAST} - 2)"), body=_digest("SELECT band, '' AS label, start, \"end\" FROM walk", 'CAST(band AS INTEGER) AS band, start, "end", tools, fails, commits, sessions, obs, files'), recursive=True),
    "window_digest": _with(CLAIMS, """
now_day AS (SELECT max(day) AS n FROM odays),
named AS (
  SELECT 0 AS band, '1996' AS label, DATE '1996-01-01' AS a, DATE '1996-12-31' AS b UNION ALL
  SELECT 1, 'mar 1997', DATE '1997-03-01', DATE '1997-03-31' UNION ALL
  SELECT 2, 'q2 ' || y, make_date(y, 4, 1), make_date(y, 6, 30) FROM (SELECT year(d) - CASE WHEN quarter(d) < 2 THEN 1 ELSE 0 END AS y FROM (SELECT DATE '1970-01-01' + CAST(n AS INTEGER) AS d FROM now_day)) UNION ALL
  SELECT 3, 'w9', w, w + 6 FROM (
    SELECT CASE WHEN w0 > d THEN CAST(date_trunc('week', make_date(y - 1, 1, 4)) AS DATE) + 56 ELSE w0 END AS w FROM (
      SELECT d, isoyear(d) AS y, CAST(date_trunc('week', make_date(CAST(isoyear(d) AS INTEGER), 1, 4)) AS DATE) + 56 AS w0 FROM (SELECT DATE '1970-01-01' + CAST(n AS INTEGER) AS d FROM now_day))) UNION ALL
  SELECT 4, 'jan 15', DATE '1998-01-15', DATE '1998-01-15' UNION ALL
  SELECT 5, 'q1 1996 – feb 1997', DATE '1996-01-01', DATE '1997-02-28' UNION ALL
  SELECT 6, '2100', DATE '2100-01-01', DATE '2100-12-31')""",
        body=_digest(f"SELECT CAST(band AS INTEGER) AS band, label, {DATE.format('a')} AS start, least({DATE.format('b')}, n) AS \"end\" FROM named, now_day", 'band, label, start, "end", tools, fails, commits, sessions, obs, files')),
    "window_children": _with(CLAIMS, """
kids AS (
  SELECT 0 AS g, strftime(m, '%b %Y') AS label, m AS a, CAST(m + INTERVAL 1 MONTH AS DATE) - 1 AS b FROM (SELECT unnest([DATE '1997-04-01', DATE '1997-05-01', DATE '1997-06-01']) AS m) UNION ALL
  SELECT 1, 'w' || week(a) || ' · ' || strftime(a, '%b ') || day(a) || '–' || day(b), a, b FROM (
    SELECT min(d) AS a, max(d) AS b FROM (SELECT CAST(unnest(generate_series(DATE '1997-04-01', DATE '1997-04-30', INTERVAL 1 DAY)) AS DATE) AS d) GROUP BY date_trunc('week', d)) UNION ALL
  SELECT 2, strftime(d, '%b ') || day(d), d, d FROM (SELECT CAST(unnest(generate_series(DATE '1997-04-01', DATE '1997-04-07', INTERVAL 1 DAY)) AS DATE) AS d)),
listed AS (SELECT CAST(row_number() OVER (ORDER BY g, a) - 1 AS INTEGER) AS band, lower(label) AS label, a, b FROM kids)""",
        body=_digest(f"SELECT band, label, {DATE.format('a')} AS start, {DATE.format('b')} AS \"end\" FROM listed", 'band, label, start, "end", tools, commits, obs, files')),
    "zoom_sessions": _with(MECH, _session_rows(M_ROWS), _sessions("allrows"), body=f"""
      SELECT session, cwd, commits, start_ms, end_ms FROM sess, (SELECT {_day("now")} AS d FROM now) WHERE start_ms < (d - 2) * 86400000 AND end_ms >= (d - 9) * 86400000"""),
    "zoom_said": _with(SPOKEN, body="SELECT session, seq, ts_ms, text FROM spoken WHERE kind = 'final' AND ts_ms >= epoch_ms(TIMESTAMP '2024-01-01') AND ts_ms < epoch_ms(TIMESTAMP '2024-02-01') ORDER BY ts_ms DESC, session, seq LIMIT 4"),
    "zoom_observations": _with(CLAIMS, body="SELECT subject, session, seq, cited, text FROM claims WHERE ts_ms >= epoch_ms(TIMESTAMP '1997-05-12') AND ts_ms < epoch_ms(TIMESTAMP '1997-05-19')"),
    "events_filtered": _with(MECH, body=f"SELECT session, seq, ts_ms, 3 AS v, kind, {_SUMMARY_MECH} AS summary FROM mech, now WHERE starts_with(session, '1') AND kind = 'tool' AND ts_ms >= now - 7 * 86400000"),
    "event_summaries": _with(MECH, CLAIMS, body=f"""
      SELECT session, seq, kind, {_SUMMARY_MECH} AS summary FROM mech UNION ALL
      SELECT session, seq, 'obs', subject || ': ' || {_clip("text", 150)} || CASE WHEN cited THEN ' [cites 2 events]' ELSE '' END || coalesce(' ' || {BASIS}, '') FROM claims"""),
    "asof_days": _with(MECH, body="""
      SELECT CAST(floor(ts_ms / 86400000.0) AS BIGINT) AS day, count(*) FILTER (kind = 'tool') AS tools, count(*) FILTER (kind = 'tool' AND NOT ok) AS fails, count(*) FILTER (kind = 'commit') AS commits,
        count(*) FILTER (kind = 'meta') AS sessions, count(*) FILTER (kind = 'file') AS touches FROM mech, now WHERE ts_ms <= now - 864000000 GROUP BY 1"""),
    "asof_subjects": _with(CLAIMS, body="""
      SELECT subject, support, ts_ms AS last_ms, text FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts_ms DESC, seq DESC, session DESC) AS r, count(*) OVER (PARTITION BY subject) AS support
        FROM claims WHERE ts_ms <= 852076800000) WHERE r = 1"""),
    "near_subjects": _with(CLAIMS, body="SELECT DISTINCT subject FROM claims WHERE subject <> 'group 1' AND (contains(subject, 'group 1') OR contains('group 1', subject)) ORDER BY subject LIMIT 4"),
    "session_prefix": _with(MECH, _session_rows(M_ROWS), _sessions("allrows"), body="SELECT session, start_ms, end_ms, commits FROM sess WHERE starts_with(session, '14') ORDER BY session LIMIT 1"),
    "byte_cap": "SELECT doc_id, " + ", ".join(f"md5({_cap('text', n)}) AS cap{n}" for n in (3, 50, 501)) + " FROM documents",
    "text_clip": f"SELECT doc_id, md5({_clip('text', 150)}) AS clipped FROM documents",
    "labels": f"""
      SELECT event_id, {_age("now", "(epoch_us(ts) // 1000)")} AS age, strftime(ts, '%Y-%m-%d') AS date,
        CASE t - d WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE (t - d) || 'd ago' END AS day,
        CASE WHEN event_id * 7 >= 10000 THEN printf('%.0fk', event_id * 7 / 1000.0) WHEN event_id * 7 >= 1000 THEN printf('%.1fk', event_id * 7 / 1000.0) ELSE CAST(event_id * 7 AS VARCHAR) END AS short,
        substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS sess
      FROM (SELECT *, {_day("epoch_us(ts) // 1000")} AS d FROM events), (SELECT now, {_day("now")} AS t FROM (SELECT max(epoch_us(ts) // 1000) AS now FROM events))""",
    "calendar_parts": """
      SELECT DISTINCT strftime(d, '%Y-%m-%d') AS day, CAST(week(d) AS INTEGER) AS week, CAST(isoyear(d) AS INTEGER) AS iso_year, CAST(isodow(d) - 1 AS INTEGER) AS weekday,
        strftime(date_trunc('month', d), '%Y-%m-%d') AS month, strftime(date_trunc('quarter', d), '%Y-%m-%d') AS quarter FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "short_paths": f"SELECT page_id, {_short_path('u')} AS short, string_split(u, '/')[-1] AS place FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS u FROM pages)",
    "subject_handles": r"""
      SELECT p_partkey, CASE WHEN regexp_full_match(s, '[A-Za-z0-9._-]*') THEN 'ledger ' || s ELSE 'ledger recall --subject "' || s || '"' END AS handle
      FROM (SELECT p_partkey, regexp_replace(p_name, ' ([a-m])', '-\1', 'g') AS s FROM part)""",
    "upsert_latest": _with(MECH, body="SELECT session, seq, kind, CASE WHEN kind = 'tool' THEN detail ELSE '' END || CASE WHEN seq % 48 = 0 THEN ' again' ELSE '' END AS detail FROM mech"),
}
ORACLE["bm25_topk"] = f"SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, score AS s FROM {_bm25('documents', 'doc_id', ['erand', 'of', 'the', 'worthless'])}) ORDER BY s DESC, doc_id LIMIT 12"
ORACLE["rrf_fused"] = f"""
      WITH kw AS (SELECT doc_id, round(s, 9) AS s FROM (SELECT doc_id, score AS s FROM {_bm25("documents", "doc_id", ["of", "the"])}) b ORDER BY b.s DESC, doc_id LIMIT 24),
      vec AS (SELECT vec_id AS doc_id, round(s, 9) AS s FROM (SELECT vec_id, {COS} AS s FROM embeddings) v ORDER BY v.s DESC, vec_id LIMIT 24),
      lanes AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM kw UNION ALL SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) FROM vec)
      SELECT doc_id, round(sum(1 / (60.0 + r)), 9) AS score FROM lanes GROUP BY doc_id"""
# Phrases that tie a claim to the moment it was made, with the reason.
_PHRASES = [
    ("tonight", "time-deictic"), ("today", "time-deictic"), ("yesterday", "time-deictic"), ("this session", "session-deictic"),
    ("this evening", "time-deictic"), ("this morning", "time-deictic"), ("just now", "time-deictic"), ("earlier", "time-deictic"),
    ("the reviewer", "person-deictic"), ("this change", "change-deictic"), ("this fix", "change-deictic"), ("in flight", "status-log"),
    ("now live", "status-log"), ("mirrors ", "status-log"), ("mirrored to", "status-log"), ("shipped", "status-log"), ("landed", "status-log"),
]
ORACLE["claim_lint"] = _with(CLAIMS, body=f"""
      SELECT session, seq, coalesce(array_to_string(list_filter([{", ".join(f"CASE WHEN contains(lower({_LINTED}), '{m}') THEN '{m}:{why}' END" for m, why in _PHRASES)}], lambda x: x IS NOT NULL), ','), '') AS lint,
        length({_LINTED}) * 6 > 240 AS long FROM claims""")  # fmt: skip


def _dialect_a(skip: int) -> str:
    """Events of the transcripts made of ``events``, from line ``skip`` on."""
    return f"""
      WITH e AS (
        SELECT 'u' || user_id AS file, 's' || user_id AS session, user_id, event_id AS n, event_type AS et, CAST(props ->> '$.k' AS BIGINT) AS k,
          row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
          coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS ts_ms,
          CASE WHEN event_type <> 'signup' THEN coalesce(lead(event_type) OVER (PARTITION BY user_id, event_type = 'signup', event_id % 4 ORDER BY event_id), '') <> 'error' END AS ok
        FROM events),
      f AS (SELECT *, min(pos) FILTER (et = 'signup') OVER (PARTITION BY file) AS meta, max(pos) FILTER (et = 'click') OVER (PARTITION BY file) AS closing FROM e),
      told AS (
        SELECT *, 0 AS slot, 'meta' AS kind, concat_ws('|', '/work/team' || (user_id % 5), CASE WHEN n % 2 = 0 THEN 'topic-' || (n % 7) END) AS what FROM f WHERE et = 'signup' AND pos = meta AND meta >= {skip}
        UNION ALL SELECT *, 2, 'user', 'hello ' || n FROM f WHERE et = 'signup'
        UNION ALL SELECT *, 2, CASE WHEN pos = closing THEN 'final' ELSE 'said' END, repeat('w', 70 + k % 20) FROM f WHERE et = 'click' AND (pos = closing OR k % 20 >= 10)
        UNION ALL SELECT *, 3, 'tool', concat_ws('|', 'Grep', '{{"pattern":"p' || k || '"}}', ok) FROM f WHERE et = 'click'
        UNION ALL SELECT *, 3, 'user', 'again ' || n FROM f WHERE et = 'error'
        UNION ALL SELECT *, 2, 'tool', concat_ws('|', 'Bash', 'git commit -m "change ' || n || '" && true', ok) FROM f WHERE et = 'purchase'
        UNION ALL SELECT *, 14, 'commit', concat_ws('|', substr(md5(CAST(n AS VARCHAR)), 1, 7), 'change ' || n) FROM f WHERE et = 'purchase'
        UNION ALL SELECT *, 2, 'tool', concat_ws('|', 'Edit', 'src/file' || k || '.rs', ok) FROM f WHERE et NOT IN ('signup', 'click', 'error', 'purchase')
        UNION ALL SELECT *, 15, 'file', 'src/file' || k || '.rs' FROM f WHERE et NOT IN ('signup', 'click', 'error', 'purchase'))
      SELECT session, pos * 16 + slot AS seq, ts_ms, kind, md5(what) AS what FROM told WHERE pos >= {skip}"""


_DIALECT_B = f"""
      WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, 1704067200000 + conv_id * 3600000 + turn * 60000 AS ts_ms FROM conversations),
      u AS (SELECT *, max(p) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS closing, min(turn) OVER (PARTITION BY conv_id) AS first,
              CASE WHEN turn % 2 = 1 THEN 'jj describe -m turn' ELSE 'ls -l ' END || turn AS cmd FROM t),
      told AS (
        SELECT conv_id, 2 AS seq, 1704067200000 + conv_id * 3600000 + first * 60000 AS ts_ms, 'meta' AS kind, '/w/c' || conv_id AS what FROM u WHERE p = 1
        UNION ALL SELECT conv_id, (2 * p - 1) * 16 + 2, ts_ms, 'user', {_cap("text", 2048)} FROM u WHERE role = 'user'
        UNION ALL SELECT conv_id, (2 * p - 1) * 16 + 2, ts_ms, 'said', {_cap("text", 1200)} FROM u WHERE role = 'assistant' AND strlen(text) >= 80 AND p <> closing
        UNION ALL SELECT conv_id, (2 * p - 1) * 16 + 2, ts_ms, 'final', {_cap("text", 8192)} FROM u WHERE p = closing
        UNION ALL SELECT conv_id, 2 * p * 16 + 2, ts_ms, 'tool', concat_ws('|', 'shell', cmd, 'true') FROM u
        UNION ALL SELECT conv_id, 2 * p * 16 + 3, ts_ms, 'commit', concat_ws('|', '', 'turn' || turn) FROM u WHERE turn % 2 = 1)
      SELECT 'c' || conv_id AS session, seq, ts_ms, kind, md5(what) AS what FROM told"""
ORACLE["transcript_parse_a"] = ORACLE["capture_resumed"] = _dialect_a(0)
ORACLE["transcript_resumed"] = _dialect_a(5)
ORACLE["transcript_parse_b"] = _DIALECT_B
ORACLE["transcript_formats"] = """
      SELECT DISTINCT 'u' || user_id AS file, CASE WHEN user_id % 3 = 0 THEN '-' ELSE 'A' END AS format, user_id % 3 = 0 AS refused FROM events
      UNION ALL SELECT DISTINCT 'c' || conv_id, 'B', FALSE FROM conversations"""
ORACLE["transcript_final_override"] = f"""
      WITH p AS ({_dialect_a(0)}) SELECT * FROM p WHERE session = 's7' AND kind <> 'final'
      UNION ALL SELECT 's7', 2147483647, max(ts_ms), 'final', md5('the work is done') FROM p WHERE session = 's7'"""


def _place(word: str) -> str:
    return f"CAST('0x' || substr(md5({word}), 1, 8) AS BIGINT)"


def _vector_lane(rel: str, query: list[str], n: int) -> str:
    """(session, seq, score) of the ``n`` texts of a relation nearest to a query by hashed vectors of 256 places."""
    sign = "1 - 2 * (h // 1048576 % 2)"
    return f"""(WITH w AS (SELECT session, seq, unnest({WORDS.format("text")}) AS x FROM {rel} WHERE kind <> 'said' AND (kind <> 'user' OR strlen(text) <= 400)),
      v AS (SELECT session, seq, h % 256 AS place, sum({sign}) AS v FROM (SELECT session, seq, {_place("x")} AS h FROM w) GROUP BY ALL),
      q AS (SELECT h % 256 AS place, sum({sign}) AS q FROM (SELECT {_place("x")} AS h FROM (SELECT unnest({query}) AS x)) GROUP BY ALL),
      norm AS (SELECT session, seq, sqrt(sum(v * v)) AS norm FROM v GROUP BY ALL),
      dot AS (SELECT session, seq, sum(v * q) AS dot FROM v JOIN q USING (place) GROUP BY ALL)
      SELECT session, seq, coalesce(dot / (norm * (SELECT sqrt(sum(q * q)) FROM q)), 0) AS score FROM norm LEFT JOIN dot USING (session, seq) WHERE norm > 0 ORDER BY score DESC, session, seq LIMIT {n})"""


def _lane(rows: str, n: int) -> str:
    return f"SELECT session, seq, 1 / (60.0 + row_number() OVER (ORDER BY score DESC, session, seq)) AS part FROM {rows} ORDER BY part DESC LIMIT {n}"


ORACLE["recall_hybrid"] = _with(CLAIMS, SPOKEN, TEXTS, body=f"""
      SELECT round(fused, 3) AS score, kind, cited, {_age("1000000000000", "ts_ms")} AS age, substr(session, 1, 8) AS session, seq,
        CASE WHEN kind = 'obs' THEN {BASIS} || CASE WHEN {_since(_day("ts_ms"))} > 0 THEN ' · ~' || {_since(_day("ts_ms"))} || ' commits since' ELSE '' END END AS basis, text
      FROM (SELECT session, seq, sum(part) AS fused FROM (({_lane(_bm25("texts", "session, seq", ["order", "urgent"]), 24)}) UNION ALL ({_lane(_vector_lane("texts", ["urgent", "order"], 10), 10)})) GROUP BY ALL)
      JOIN texts USING (session, seq) WHERE kind = 'obs' ORDER BY fused DESC, texts.session, seq LIMIT 12""")
ORACLE["further"] = _with(CLAIMS, _bands(8, "(SELECT min(day) FROM (SELECT day FROM odays ORDER BY day DESC LIMIT 3))"),
                          body=_digest("SELECT band, '' AS label, start, \"end\" FROM walk", 'CAST(band AS INTEGER) AS band, start, "end", tools, fails, commits, sessions, obs, files'), recursive=True)
_NAMED = "lower(strftime({0}, '%b')) || ' ' || day({0})"
ORACLE["span_labels"] = _with(CLAIMS, body=f"""
      SELECT DISTINCT day - back AS start, day AS "end", CASE WHEN back = 0 THEN '' WHEN date_trunc('month', a) = date_trunc('month', b) THEN {_NAMED.format("a")} || '–' || day(b)
        WHEN year(a) = year(b) THEN {_NAMED.format("a")} || ' – ' || {_NAMED.format("b")} ELSE {_NAMED.format("a")} || ' ' || year(a) || ' – ' || {_NAMED.format("b")} || ' ' || year(b) END AS span
      FROM (SELECT day, back, {_DAYS1970.format("(day - back)")} AS a, {_DAYS1970.format("day")} AS b FROM (SELECT min(day) AS day FROM odays UNION ALL SELECT max(day) FROM odays), (SELECT unnest([0, 6, 30, 400]) AS back))""")
ORACLE["relevant"] = _with(CLAIMS, SPOKEN, TEXTS, body=f"""
      SELECT session, seq, round(score, 9) AS score, kind || CASE WHEN kind = 'obs' AND cited THEN '·cited' ELSE '' END || ' · ' || {_age("1000000000000", "ts_ms")} AS tag, text FROM (
        SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, seq) AS nth FROM ({_lane(_bm25("texts", "session, seq", ["of", "order", "the", "urgent"]), 60).replace("AS part", "AS score").replace("BY part", "BY score")}))
      JOIN texts USING (session, seq) WHERE nth <= 2 ORDER BY score DESC, session, seq LIMIT 6""")
_BOTH = _session_rows(M_ROWS + " UNION ALL SELECT session, seq, ts_ms, 'obs', NULL, NULL, text FROM claims")
ORACLE["show_session"] = _with(MECH, CLAIMS, _BOTH, _sessions("allrows"), body="""
      SELECT s.session, place, CASE WHEN NOT (ends_with(branch, place) OR ends_with(place, branch)) THEN branch END AS shown_branch, commits, start_ms, end_ms, subject, c.seq, c.text
      FROM (SELECT *, string_split(cwd, '/')[-1] AS place FROM sess WHERE starts_with(session, '14') ORDER BY session LIMIT 1) s LEFT JOIN claims c ON c.session = s.session""")
ORACLE["show_event"] = _with(MECH, CLAIMS, _BOTH, _sessions("allrows"), body="""
      , cites AS (SELECT session, seq AS citer, subject, unnest(derived) AS seq FROM claims),
      pick AS (SELECT coalesce(min(c.seq), 0) AS seq FROM cites c JOIN allrows a ON a.session = c.session AND a.seq = c.seq WHERE c.session = '14'),
      found AS (SELECT session FROM sess WHERE starts_with(session, '14') ORDER BY session LIMIT 1)
      SELECT a.session, a.seq, a.kind, a.ts_ms, c.citer, c.subject FROM allrows a JOIN found USING (session) JOIN pick ON a.seq = pick.seq LEFT JOIN cites c ON c.session = a.session AND c.seq = a.seq""")
ORACLE["dispatch_trail"] = "SELECT 'trail' AS read, * FROM (" + ORACLE["subject_trail"] + ")"
ORACLE["dispatch_zoom"] = "SELECT 'zoom' AS read, * FROM (" + ORACLE["zoom_observations"] + ")"
ORACLE["ledger_export"] = _with(CLAIMS, body="""
      SELECT '{"session":"' || session || '","seq":' || seq || ',"ts_ms":' || ts_ms || ',"v":3,"event":{"kind":"obs","text":"' || text || '","subject":"' || subject || '","derived_from":[' || array_to_string(derived, ',') || ']'
        || CASE WHEN commit IS NULL THEN '' ELSE ',"basis":{"commit":"' || commit || '","dirty":' || dirty || '}' END || '}}' AS value FROM claims""")
ORACLE["local_days"] = "SELECT strftime(d, '%Y-%m-%d') AS day, epoch_ms(CAST(d AS TIMESTAMP)) + 86399000 - 19800000 AS ms FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"
ORACLE["transcript_compactions"] = f"""
      WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, 1704067200000 + conv_id * 3600000 + turn * 60000 AS ts_ms FROM conversations),
      told AS (
        SELECT 'a' || conv_id AS session, p * 16 + 1 AS seq, ts_ms, 'compacted' AS kind, '' AS what FROM t
        UNION ALL SELECT 'a' || conv_id, p * 16 + 2, ts_ms, 'compact', {_cap("text", 8192)} FROM t
        UNION ALL SELECT 'b' || conv_id, 2, ts_ms, 'meta', '/w' FROM t WHERE p = 1
        UNION ALL SELECT 'b' || conv_id, p * 16 + 2, ts_ms, 'compacted', '' FROM t
        UNION ALL SELECT 'b' || conv_id, p * 16 + 3, ts_ms, 'compact', {_cap("text", 8192)} FROM t WHERE {_squeeze("text")} <> '')
      SELECT session, seq, ts_ms, kind, md5(what) AS what FROM told"""
# Views of events after every seventh was moved and every eleventh taken out.
_MOVED = "CASE WHEN seq % 7 = 0 THEN ts_ms + 86400000 ELSE ts_ms END AS ts_ms"
REVISED = f"""
rmech AS (SELECT * REPLACE ({_MOVED}) FROM mech WHERE seq % 11 <> 0),
rspoken AS (SELECT * REPLACE ({_MOVED}) FROM spoken WHERE seq % 11 <> 0),
rclaims AS (SELECT * REPLACE ({_MOVED}, CASE WHEN seq % 14 = 0 THEN subject || ' b' ELSE subject END AS subject, CASE WHEN seq % 7 = 0 THEN text || ' revised' ELSE text END AS text) FROM claims WHERE seq % 11 <> 0)"""
_ALL = [MECH, SPOKEN, CLAIMS, REVISED]
_RDAY = _day("ts_ms")
ORACLE["store_days"] = _with(*_ALL, body=f"""
      SELECT {_RDAY} AS day, count(*) FILTER (kind = 'tool') AS tools, count(*) FILTER (kind = 'tool' AND NOT ok) AS fails, count(*) FILTER (kind = 'commit') AS commits,
        count(*) FILTER (kind = 'meta') AS sessions, count(*) FILTER (kind = 'file') AS touches FROM rmech GROUP BY 1""")
ORACLE["store_sessions"] = _with(*_ALL, _session_rows(M_ROWS.replace("FROM mech", "FROM rmech") + " UNION ALL " + S_ROWS.replace("FROM spoken", "FROM rspoken")), _sessions("allrows"), body="SELECT * FROM sess")
ORACLE["store_subjects"] = _with(*_ALL, SUBJ.replace("FROM claims", "FROM rclaims"), body="SELECT * FROM subj")
ORACLE["store_files"] = _with(*_ALL, body=f"""
      SELECT path, {_RDAY} AS day, count(*) AS n, (SELECT string_agg(DISTINCT session, ',' ORDER BY session) FROM rmech r WHERE r.path = m.path) AS sessions FROM rmech m WHERE kind = 'file' GROUP BY path, day""")
ORACLE["store_obs_per_day"] = _with(*_ALL, body=f"SELECT {_RDAY} AS day, count(*) AS obs FROM rclaims GROUP BY 1")
ORACLE["store_asof"] = ORACLE["obs_per_day"]
ORACLE["store_keyword"] = _with(*_ALL, TEXTS.replace("FROM claims", "FROM rclaims").replace("FROM spoken", "FROM rspoken"), body=f"""
      SELECT session, seq, round(s, 6) AS score FROM (SELECT session, seq, score AS s FROM {_bm25("texts", "session, seq", ["order", "revised", "urgent"])}) ORDER BY s DESC, session, seq LIMIT 12""")
ORACLE["observe_claim"] = _with(CLAIMS, body="""
      SELECT '7' AS session, coalesce(max(seq) FILTER (session = '7'), 2147483647) + 2 AS seq, 'group 1' AS subject, 'it landed earlier' AS text, count(*) FILTER (subject = 'group 1') + 2 AS support, 'earlier,landed' AS lint,
        (SELECT string_agg(subject, ',' ORDER BY subject) FROM (SELECT DISTINCT subject FROM claims WHERE subject <> 'group 1' AND (contains(subject, 'group 1') OR contains('group 1', subject)) ORDER BY subject LIMIT 4)) AS near, '@abcdef01+' AS basis FROM claims""")
# The brief's bands and drift come from the days of the events.
_ONLY = CLAIMS.split("odays AS")[0].rstrip().rstrip(",")
_BRIEF_DAYS = f"""
odays AS (SELECT day, tools, fails, commits, sessions FROM days), ofiles AS (SELECT day, path, n FROM day_files), operday AS (SELECT {_day("ts_ms")} AS day, count(*) AS obs FROM claims GROUP BY 1)"""
_JSON = lambda name, fields, rows: f"SELECT '{name}' AS section, CAST(to_json(struct_pack({fields})) AS VARCHAR) AS json FROM ({rows})"
ORACLE["brief_json"] = _with(MECH, _ONLY, _BRIEF_DAYS, _bands(8, "(SELECT min(day) FROM (SELECT day FROM odays ORDER BY day DESC LIMIT 3))"), _session_rows(M_ROWS), _sessions("allrows"), SUBJ, body=" " + " UNION ALL ".join([
    _JSON("today", "today := today", "SELECT strftime(epoch_ms(now), '%Y-%m-%d') AS today FROM now"),
    _JSON("active", '"where" := "where", session := session, age := age, commits := commits', f"""SELECT session, string_split(cwd, '/')[-1] AS "where", {_age("now", "end_ms")} AS age, commits FROM sess, now WHERE greatest(now - end_ms, 0) < 3600000 ORDER BY end_ms DESC, session LIMIT 6"""),
    _JSON("days", "day := label, tools := tools, fails := fails, commits := commits, sessions := sessions, files := files", f"""
      SELECT CASE t - day WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE (t - day) || 'd ago' END AS label, tools, fails, commits, sessions,
        coalesce((SELECT list({_short_path("path")} ORDER BY n DESC, path) FROM (SELECT * FROM day_files f WHERE f.day = days.day ORDER BY n DESC, path LIMIT 4)), []) AS files FROM days, (SELECT {_day("now")} AS t FROM now) ORDER BY day DESC LIMIT 3"""),
    _JSON("further", '"start" := start, "end" := "end", tools := tools, fails := fails, commits := commits, sessions := sessions, obs := obs, files := CASE WHEN files = \'\' THEN [] ELSE string_split(files, \'|\') END', _digest("SELECT band, '' AS label, start, \"end\" FROM walk", 'start, "end", tools, fails, commits, sessions, obs, files')),
    _JSON("last_session", "age := '', branch := branch, final_msg := final_msg", "SELECT * FROM sess WHERE final_msg <> ''"),
    _JSON("files", "path := path, sessions := sessions", f"""
      SELECT {_short_path("path")} AS path, (SELECT list(DISTINCT substr(session, 1, 8) ORDER BY substr(session, 1, 8)) FROM mech m WHERE m.path = b.path) AS sessions
      FROM (SELECT path, CAST(sum(n) AS BIGINT) AS touches FROM day_files WHERE day IN (SELECT day FROM days ORDER BY day DESC LIMIT 3) GROUP BY path ORDER BY touches DESC, path LIMIT 5) b"""),
    _JSON("subjects", "subject := subject, \"count\" := support, cited := cited, age := age, basis := basis, text := text, handle := handle", f"""
      SELECT subject, support, cited, {_age("now", "last_ms")} AS age, text, CASE WHEN basis = '' THEN NULL WHEN since > 0 THEN basis || ' · ~' || since || ' commits since' ELSE basis END AS basis, 'ledger recall --subject "' || subject || '"' AS handle
      FROM (SELECT *, {_since(_day("last_ms"))} AS since FROM subj ORDER BY last_ms DESC, subject LIMIT 5), now"""),
]), recursive=True)
