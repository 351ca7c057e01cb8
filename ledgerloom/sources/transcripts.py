"""Session transcripts in JSON lines, in two dialects, to ledger events. Malformed lines give nothing; unknown files are reported.

Everything is Column expressions over VARIANT values in one pass: lines are gathered by file, windows over the file find its
dialect, session, times and closing message, each line and each content block becomes a row with an array of its events, and
those are exploded. A dialect is one pass with one exchange, by file. The sequence number of an event is 16 * line + slot, so parsing
again, or from a later line, yields the same keys. Where two events of a file share a key, the one emitted last stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import byte_cap, is_blank, iso_to_ms, squeeze

HEAD_LINES, HEAD_METAS, BLOCKS = 8, 5, 14
EMBED_VERSION = "hashed-terms-2 dim=256"
GONE = "gone"  # takes back an event captured before: its key says nothing any more
_RANK = 64  # emission ranks a line: 4 a block and some before


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, pos (from 0, of all lines), line. Large files are read by byte ranges, each by a task of its own."""
    split = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(paths, lineSep="\n").select(*split, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    # lines of one split are numbered without gaps; a prefix sum over a file's splits tells where each begins
    splits = rows.groupBy("path", "block").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "block", "low", F.coalesce(before, F.lit(0)).alias("first"))
    name = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("file")
    return rows.join(splits, ["path", "block"]).select(name, (F.col("first") + F.col("at") - F.col("low")).cast("int").alias("pos"), "line")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """A string at a path; null if there is anything else."""
    return F.when(F.schema_of_variant(_get(v, path, "variant")) == "STRING", _get(v, path, "string"))


def _true(v: Column, path: str) -> Column:
    x = _get(v, path, "variant")
    return F.coalesce(F.when(F.schema_of_variant(x) == "BOOLEAN", _get(v, path, "boolean")), F.lit(False))


def _file(ordered: bool = False) -> Window:
    by = Window.partitionBy("file")
    return by.orderBy("pos") if ordered else by


def _marked(lines: DataFrame) -> DataFrame:
    """``lines`` with v (the line parsed) and format: 'A', 'B' or null, by positive signs in the first non-blank lines of the file only."""
    upto = _file(ordered=True).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = ~is_blank(F.col("line"))
    rows = lines.withColumn("v", F.try_parse_json("line")).withColumn("head", filled & (F.count_if(filled).over(upto) <= HEAD_LINES))
    rows = rows.withColumn("m", F.count_if(F.col("head") & F.col("v").isNotNull()).over(upto))
    meta = F.col("head") & (F.col("m") <= HEAD_METAS) & F.coalesce(_text(F.col("v"), "$.type") == "session_meta", F.lit(False))
    known = F.col("head") & _text(F.col("v"), "$.sessionId").isNotNull()
    rows = rows.withColumns({"b": F.max(meta).over(_file()), "a": F.max(known).over(_file())})
    return rows.withColumn("format", F.when(F.col("b"), "B").when(F.col("a"), "A")).drop("head", "m", "a", "b")


def formats(lines: DataFrame) -> DataFrame:
    """file, format of each file."""
    return _marked(lines).groupBy("file").agg(F.max("format").alias("format"))


def _prepared(lines: DataFrame, cursors: DataFrame | None, fallback: str | None) -> DataFrame:
    """Parsed lines of known files: file, pos, v, ts_ms, format, session, skip, saved, seen (the skipped part has a working folder)."""
    upto = _file(ordered=True).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = _file(ordered=True).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if cursors is not None:
        lines = lines.join(cursors, "file", "left")
    given = lambda name: F.coalesce(name, F.lit(0)) if cursors is not None and name in cursors.columns else F.lit(0)
    rows = _marked(lines.withColumns({"skip": given("skip"), "saved": given("saved")}))
    rows = rows.withColumn("seen", F.max((F.col("pos") < F.col("skip")) & F.contains("line", F.lit('"cwd"'))).over(_file())).drop("line")
    rows = rows.where("format is not null and v is not null")
    v = F.col("v")
    rows = rows.withColumn("ts_ms", F.coalesce(F.last(iso_to_ms(_text(v, "$.timestamp")), ignorenulls=True).over(upto), F.lit(0).cast("bigint")))
    named = F.when(F.col("format") == "A", _text(v, "$.sessionId")).when(_text(v, "$.type") == "session_meta", _text(v, "$.payload.session_id"))
    return rows.withColumn("session", F.coalesce(F.first(named, ignorenulls=True).over(whole), F.lit(fallback))).where("session is not null")


def _event(when: Column, kind: str, slot: Column | int, rank: Column | int, **payload: Column) -> Column:
    """The event of a row for which ``when`` is true, else null; slot and rank are relative to the line."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    seq = F.col("pos").cast("bigint") * S.STRIDE + lit(slot).cast("bigint")
    ord_ = F.col("pos").cast("bigint") * _RANK + lit(rank).cast("bigint")
    fields = [(payload[n] if n in payload else F.lit(None)).cast(t).alias(n) for n, t in S.PAYLOAD.items()]
    return F.when(when, F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), *fields, ord_.alias("ord")))


def _commit_command(cmd: Column) -> Column:
    return F.contains(cmd, F.lit("git commit")) | F.contains(cmd, F.lit("jj describe"))


def commit_message(cmd: Column) -> Column:
    """What follows the first -m: a quoted text or one word."""
    rest = F.regexp_replace(F.right(cmd, F.length(cmd) - F.locate("-m", cmd) - 1), r"(?U)^\s+", "")
    quote = F.substring(rest, 1, 1)
    quoted = F.when(quote == '"', F.substring_index(F.substring(rest, 2, 1 << 30), '"', 1)).when(quote == "'", F.substring_index(F.substring(rest, 2, 1 << 30), "'", 1))
    word = F.regexp_extract(rest, r"(?U)^(\S*)", 1)
    return byte_cap(F.when(F.locate("-m", cmd) == 0, F.lit("")).otherwise(F.coalesce(quoted, word)), S.MESSAGE_BYTES)


def commit_hash(out: Column) -> Column:
    """The second word from the first '[' on, letters and digits only."""
    from_ = F.right(out, F.length(out) - F.locate("[", out) + 1)
    word = F.try_element_at(F.split(squeeze(from_), " "), F.lit(2))
    return F.coalesce(F.when(F.locate("[", out) > 0, F.regexp_replace(word, "[^A-Za-z0-9]", "")), F.lit(""))


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _first_line(rows: DataFrame, has: Column) -> DataFrame:
    """``rows`` with first: the file's first line, from the cursor on, for which ``has`` is true, unless the part before had it."""
    fits = _no(has) & (F.col("pos") >= F.col("skip")) & ~F.col("seen")
    return rows.withColumn("first", _no(F.min(F.when(fits, F.col("pos"))).over(_file()) == F.col("pos")))


def _closing(rows: DataFrame, has: Column, slot: Column) -> DataFrame:
    """``rows`` with closing: the last of the file's rows, from the cursor on, for which ``has`` is true; stale: the one that was last when only
    the ``saved`` lines were read, if it isn't now."""
    at = F.struct("pos", slot.alias("slot"))
    last = lambda part: _no(F.max(F.when(_no(has) & part, at)).over(_file()) == at) & _no(has)
    rows = rows.withColumns({"closing": last(F.col("pos") >= F.col("skip")), "was": last(F.col("pos") < F.col("saved"))})
    return rows.withColumn("stale", F.col("was") & ~F.col("closing") & F.max("closing").over(_file()))


def _exploded(rows: DataFrame, events: list[Column], changed: Column) -> DataFrame:
    """The events of lines from the cursor on, and of earlier lines in which a row is ``changed`` by what follows."""
    names = ["seq", "kind", *S.PAYLOAD, "ord"]
    rows = rows.withColumn("again", F.max(changed).over(Window.partitionBy("file", "pos")))
    out = rows.where((F.col("pos") >= F.col("skip")) | F.col("again")).select("file", "session", "ts_ms", F.explode(F.array_compact(F.array(*events))).alias("e"))
    return out.select("file", "session", "ts_ms", *(F.col(f"e.{n}").alias(n) for n in names), F.lit(S.EVENT_VERSION).alias("v"))


def _dialect_a(rows: DataFrame) -> DataFrame:
    v, b = F.col("v"), F.col("block")
    rows = _first_line(rows, _text(v, "$.cwd").isNotNull())
    rows = rows.withColumns({
        "type": _text(v, "$.type"), "compact": _true(v, "$.isCompactSummary"), "body": _text(v, "$.message.content"),
        "stdout": F.coalesce(_text(v, "$.toolUseResult.stdout"), F.lit("")), "line_error": _true(v, "$.toolUseResult.is_error"),
    })
    spoken = ~F.col("compact") & F.col("type").isin("user", "assistant")
    blocks = F.when(spoken, F.slice(_get(v, "$.message.content", "array<variant>"), 1, BLOCKS))
    # the line itself (n = 0), then each block of it
    rows = rows.withColumn("blocks", blocks).withColumn("n", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(F.size("blocks"), F.lit(0)), F.lit(0)))))
    rows = rows.withColumn("block", F.when(F.col("n") > 0, F.try_element_at("blocks", F.greatest("n", F.lit(1))))).drop("blocks")
    line, bi = F.col("n") == 0, F.col("n") - 1
    slot, rank = bi + 2, bi * 4 + 4
    rows = rows.withColumns({"bt": F.coalesce(_text(b, "$.type"), F.lit("")), "t": _text(b, "$.text")})
    said = (F.col("bt") == "text") & F.col("t").isNotNull()
    rows = _closing(rows, said & (F.col("type") == "assistant"), slot)

    call = F.col("bt") == "tool_use"
    error = (F.col("bt") == "tool_result") & (_true(b, "$.is_error") | F.col("line_error"))
    rows = rows.withColumn("id", F.when(call, _text(b, "$.id")).when(error, _text(b, "$.tool_use_id")))
    # an error marks the last call with its id before it: the row after such a call is an error
    rows = rows.withColumn("error", error & F.col("id").isNotNull())
    by_id = Window.partitionBy("file", "id").orderBy("pos", "n")
    rows = rows.withColumns({"failed": F.col("id").isNotNull() & _no(F.lead("error").over(by_id)), "next": F.lead("pos").over(by_id)})
    rows = rows.withColumns({"ok": ~F.col("failed"), "late": call & F.col("failed") & (F.col("saved") > F.col("pos")) & (F.col("next") >= F.col("saved"))})
    rows = rows.withColumns({"tool": F.coalesce(_text(b, "$.name"), F.lit("unknown")), "cmd": _text(b, "$.input.command"), "path": _text(b, "$.input.file_path")})
    tool, cmd, path, t, body = (F.col(c) for c in ("tool", "cmd", "path", "t", "body"))
    given = F.coalesce(F.to_json(_get(b, "$.input", "variant")), F.lit(""))
    on_file = tool.isin("Edit", "Write", "NotebookEdit")
    detail = F.when(tool == "Bash", F.coalesce(cmd, F.lit(""))).when(on_file | (tool == "Read"), F.coalesce(path, F.lit(""))).otherwise(F.when(given == "null", "").otherwise(given))
    user, assistant = F.col("type") == "user", F.col("type") == "assistant"
    return _exploded(rows, [
        _event(line & F.col("first"), "meta", 0, 0, cwd=_text(v, "$.cwd"), branch=_text(v, "$.gitBranch"), embed_version=F.lit(EMBED_VERSION)),
        _event(line & F.col("compact"), "compacted", 1, 1),
        _event(line & F.col("compact") & body.isNotNull(), "compact", 2, 2, text=byte_cap(body, S.FINAL_BYTES)),
        _event(line & ~F.col("compact") & user & body.isNotNull(), "user", 2, 2, text=byte_cap(body, S.USER_BYTES)),
        _event(said & user, "user", slot, rank, text=byte_cap(t, S.USER_BYTES)),
        _event(said & assistant & (F.octet_length("t") >= S.SAID_LEAST), "said", slot, rank, text=byte_cap(t, S.SAID_BYTES)),
        _event(F.col("closing"), "final", slot, F.lit(1 << 50), text=byte_cap(t, S.FINAL_BYTES)),
        _event(F.col("stale"), GONE, slot, -1),
        _event(call, "tool", slot, rank, tool=tool, detail=byte_cap(detail, S.DETAIL_BYTES), ok=F.col("ok")),
        _event(call & on_file & path.isNotNull(), "file", S.STRIDE - 1, rank + 1, path=path),
        _event(call & (tool == "Bash") & _no(_commit_command(cmd)), "commit", S.STRIDE - 2, rank + 2, hash=commit_hash(F.col("stdout")), message=commit_message(cmd)),
    ], F.col("stale") | F.col("late"))


def _dialect_b(rows: DataFrame) -> DataFrame:
    v, p = F.col("v"), F.col("p")
    rows = rows.withColumns({"type": _text(v, "$.type"), "p": _get(v, "$.payload", "variant")}).where("p is not null")
    rows = _first_line(rows, F.col("type") == "session_meta")
    as_text = lambda x: F.when(F.schema_of_variant(F.try_variant_get(x, "$.text", "variant")) == "STRING", F.try_variant_get(x, "$.text", "string"))
    parts = F.filter(F.transform(_get(p, "$.content", "array<variant>"), as_text), lambda x: x.isNotNull())
    rows = rows.withColumns({"it": F.when(F.col("type") == "response_item", _text(p, "$.type")), "role": _text(p, "$.role"), "t": F.array_join(parts, " "), "opening": _text(p, "$.content[0].text"), "args": _text(p, "$.arguments")})
    a, t = F.try_parse_json("args"), F.col("t")
    named = _get(a, "$.cmd", "variant")
    rows = rows.withColumn("cmd", F.when(named.isNotNull(), _text(a, "$.cmd")).otherwise(_text(a, "$.command")))
    spoken = (F.col("it") == "message") & ~is_blank(t)
    rows = _closing(rows, spoken & (F.col("role") == "assistant") & F.col("opening").isNotNull(), F.lit(2))
    message = _text(p, "$.message")
    words = F.coalesce(F.when(~is_blank(message), message), _text(p, "$.replacement_history[0].content[0].text"))
    compacted, call = F.col("type") == "compacted", F.col("it").isin("function_call", "custom_tool_call")
    return _exploded(rows, [
        _event(F.col("first"), "meta", 2, 0, cwd=F.coalesce(_text(p, "$.cwd"), F.lit("")), embed_version=F.lit(EMBED_VERSION)),
        _event(compacted, "compacted", 2, 1),
        _event(compacted & ~is_blank(words), "compact", 3, 2, text=byte_cap(words, S.FINAL_BYTES)),
        _event(spoken & (F.col("role") == "user"), "user", 2, 1, text=byte_cap(t, S.USER_BYTES)),
        _event(spoken & (F.col("role") == "assistant") & (F.octet_length("t") >= S.SAID_LEAST), "said", 2, 1, text=byte_cap(t, S.SAID_BYTES)),
        _event(F.col("closing"), "final", 2, F.lit(1 << 50), text=byte_cap(F.col("opening"), S.FINAL_BYTES)),
        _event(F.col("stale"), GONE, 2, -1),
        _event(call, "tool", 2, 1, tool=F.coalesce(_text(p, "$.name"), F.lit("unknown")), detail=byte_cap(F.coalesce("cmd", "args", F.lit("")), S.DETAIL_BYTES), ok=F.lit(True)),
        _event(call & _no(_commit_command(F.col("cmd"))), "commit", 3, 2, hash=F.lit(""), message=commit_message(F.col("cmd"))),
    ], F.col("stale"))


def parse(lines: DataFrame, fallback: str | None = None, cursors: DataFrame | None = None) -> DataFrame:
    """Events of transcripts (file, pos, line): the ledger's columns, file and ord (order of emission). Keys are distinct.

    ``cursors`` (file, skip) keeps events of lines from ``skip`` on; times and failures still come from the whole file. With ``saved`` (lines
    read before) earlier lines come again if what follows changes them: a call that failed later, a message that no longer closes (its old
    key is taken back by a ``GONE`` row, unless another event has it).
    """
    rows = _prepared(lines, cursors, fallback)
    found = _dialect_a(rows.where("format = 'A'")).unionByName(_dialect_b(rows.where("format = 'B'")))
    names = [*S.COLUMNS, "ord"]
    last = found.groupBy("file", "session", "seq").agg(F.max_by(F.struct(*names), "ord").alias("e"))
    return last.select("file", "e.*")


def kept(lines: DataFrame, margin: int, closing: DataFrame) -> DataFrame:
    """The lines of a transcript that parsing it from its end on still needs, with their positions: its head, the first to name the session
    and the working folder, the last closing message, the last call of each id that no result has answered, the last ``margin`` lines,
    and for each of these the last line with a time up to it. ``closing`` (file, pos): the lines of closing messages.

    These and what follows parse like the whole file, but for an error to a call that was answered more than ``margin`` lines ago.
    """
    by, upto = _file(), _file(ordered=True).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains("line", F.lit(f'"{w}"')) for w in words])
    first = lambda c: F.coalesce(F.min(F.when(c, F.col("pos"))).over(by) == F.col("pos"), F.lit(False))
    filled = ~is_blank(F.col("line"))
    ids = lambda key: F.regexp_extract_all("line", F.lit(f'"{key}"\\s*:\\s*"([^"]*)"'), F.lit(1))
    calls = lines.where(has("tool_use")).select("file", "pos", F.explode(ids("id")).alias("id")).groupBy("file", "id").agg(F.max("pos").alias("pos"))
    answers = lines.where(has("tool_use_id")).select("file", F.explode(ids("tool_use_id")).alias("id"), F.col("pos").alias("answer")).groupBy("file", "id").agg(F.max("answer").alias("answer"))
    open_ = calls.join(answers, ["file", "id"], "left").where("answer is null or answer < pos").select("file", "pos")
    wanted = open_.withColumn("closing", F.lit(False)).unionByName(closing.select("file", "pos", F.lit(True).alias("closing"))).groupBy("file", "pos").agg(F.max("closing").alias("closing"), F.lit(True).alias("wanted"))
    rows = lines.join(wanted, ["file", "pos"], "left").withColumn("timed", F.get_json_object("line", "$.timestamp").isNotNull())
    head = filled & (F.count_if(filled).over(upto) <= HEAD_LINES)
    keep = head | first(has("sessionId", "session_id")) | first(has("cwd")) | F.coalesce("wanted", F.lit(False)) | (F.col("pos") >= F.max("pos").over(by) + 1 - margin)
    rows = rows.withColumns({"keep": keep, "at": F.max(F.when(F.col("timed"), F.col("pos"))).over(upto)})
    times = F.collect_set(F.when(F.col("keep"), F.col("at"))).over(by)  # no more than there are kept lines
    return rows.withColumn("keep", F.col("keep") | F.array_contains(times, F.col("pos"))).where("keep").select("file", "pos", "line", F.coalesce("closing", F.lit(False)).alias("closing"))


def rejected(lines: DataFrame) -> DataFrame:
    """Files with content that are of no known format."""
    filled = lines.where(~is_blank(F.col("line"))).select("file").distinct()
    return formats(lines).where("format is null").join(filled, "file", "left_semi").select("file")


def with_final_message(events: DataFrame, session: str, text: str | None) -> DataFrame:
    """A session's events with a given closing message in place of the parsed one; blank texts change nothing."""
    if text is None or not text.strip():
        return events
    stamp = events.agg(F.coalesce(F.max("ts_ms"), F.lit(0).cast("bigint")).alias("ts_ms"))
    row = stamp.select(F.lit(session).alias("session"), F.lit(S.HOOK_FINAL_SEQ).alias("seq"), "ts_ms", F.lit("final").alias("kind"), byte_cap(F.lit(text), S.FINAL_BYTES).alias("text"))
    return events.where("kind <> 'final'").unionByName(S.conform(row), allowMissingColumns=True)
