"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DAY_MS, HOUR_MS

# Phrases that tie a claim to the moment it was made, with the reason.
LINT = {
    "tonight": "time-deictic", "today": "time-deictic", "yesterday": "time-deictic", "this session": "session-deictic",
    "this evening": "time-deictic", "this morning": "time-deictic", "just now": "time-deictic", "earlier": "time-deictic",
    "the reviewer": "person-deictic", "this change": "change-deictic", "this fix": "change-deictic", "in flight": "status-log",
    "now live": "status-log", "mirrors ": "status-log", "mirrored to": "status-log", "shipped": "status-log", "landed": "status-log",
}
LONG_CLAIM = 240


def byte_cap(s: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` bytes that ends between characters."""
    raw = s.cast("binary")
    cut = [F.substring(raw, 1, most - k).cast("string") for k in range(min(4, most + 1))]
    return F.when(F.octet_length(s) <= most, s).otherwise(F.coalesce(*(F.when(F.is_valid_utf8(c), c) for c in cut), F.lit("")))


def squeeze(s: Column) -> Column:
    """White space of any script as single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def clip(s: Column, most: int) -> Column:
    flat = squeeze(s)
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("…")))


def is_blank(s: Column) -> Column:
    return squeeze(s) == ""


def short_count(n: Column) -> Column:
    """12 -> 12, 1234 -> 1.2k, 14036 -> 14k. A tie goes the way the nearest double of n / 1000 lies, and to even if it is exact."""
    size = F.abs(n)
    down = [i for i in range(1050, 10_000, 100) if round(i / 1000, 1) * 10 < i // 100 + 0.5]
    tenths = F.floor((size + 50) / 100) - size.isin(down).cast("bigint")
    sign = F.when(n < 0, F.lit("-")).otherwise(F.lit(""))
    small = F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))
    return F.when(size >= 10_000, F.concat(sign, F.bround(size / 1000, 0).cast("bigint").cast("string"), F.lit("k"))).when(size >= 1_000, small).otherwise(n.cast("string"))


def short_path(p: Column) -> Column:
    return F.when(F.size(F.split(p, "/")) >= 3, F.concat(F.lit("…/"), F.substring_index(p, "/", -2))).otherwise(p)


def short_session(s: Column) -> Column:
    return F.substring(s, 1, 8)


def place(cwd: Column) -> Column:
    return F.substring_index(cwd, "/", -1)


def age_label(now: int | Column, ts: Column) -> Column:
    gap = F.greatest((F.lit(now) if isinstance(now, int) else now) - ts, F.lit(0).cast("bigint"))
    hours, days = F.floor(gap / HOUR_MS).cast("string"), F.floor(gap / DAY_MS).cast("string")
    return F.when(gap < HOUR_MS, F.lit("<1h")).when(gap < DAY_MS, F.concat(hours, F.lit("h"))).otherwise(F.concat(days, F.lit("d")))


def day_of(ts_ms: Column) -> Column:
    return F.floor(ts_ms / DAY_MS).cast("bigint")


def day_label(day: Column, today: int) -> Column:
    back = F.lit(today) - day
    return F.when(back == 0, "today").when(back == 1, "yesterday").otherwise(F.concat(back.cast("string"), F.lit("d ago")))


def date_label(ts_ms: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day_of(ts_ms).cast("int")), "yyyy-MM-dd")


def iso_to_ms(s: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 time; a zone suffix is not applied; null if it is none."""
    bare = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?)", 1)
    return F.when(F.octet_length(s) >= 20, F.unix_millis(F.try_to_timestamp(F.concat(F.nullif(bare, F.lit("")), F.lit("Z")))))


def local_day_ms(day: Column, clock: str, zone: str) -> Column:
    """Epoch milliseconds of a local time on a date, by the zone's offset on that date."""
    return F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp(F.concat(day, F.lit(" " + clock))), zone))


def iso_week(d: Column) -> Column:
    return F.weekofyear(d)


def iso_year(d: Column) -> Column:
    return F.year(F.date_add(d, F.lit(3) - F.weekday(d)))


def basis_label(basis: Column) -> Column:
    return F.concat(F.lit("@"), F.substring(basis["commit"], 1, 8), F.when(basis["dirty"], F.lit("+")).otherwise(F.lit("")))


def basis_label_with(basis: Column, since: Column) -> Column:
    return F.when(since > 0, F.concat(basis_label(basis), F.lit(" · ~"), since.cast("string"), F.lit(" commits since"))).otherwise(basis_label(basis))


def subject_handle(subject: Column, command: str) -> Column:
    bare = F.concat(F.lit(command + " "), subject)
    quoted = F.concat(F.lit(command + ' recall --subject "'), subject, F.lit('"'))
    return F.when(subject.rlike(r"^[A-Za-z0-9._-]*$"), bare).otherwise(quoted)


def lint_notes(text: Column) -> Column:
    """Array of (phrase, reason) of the phrases a claim should not use."""
    low = F.lower(text)
    marks = F.array(*(F.when(F.contains(low, F.lit(m)), F.struct(F.lit(m).alias("phrase"), F.lit(why).alias("reason"))) for m, why in LINT.items()))
    return F.array_compact(marks)


def lint_reasons(text: Column) -> Column:
    """Array of the phrases a claim should not use."""
    return lint_notes(text)["phrase"]


def is_long_claim(text: Column) -> Column:
    return F.char_length(text) > LONG_CLAIM


def cited(derived_from: Column) -> Column:
    return F.coalesce(F.size(derived_from) > 0, F.lit(False))


def summary(most: int = 150) -> Column:
    """One line a ledger row, by its kind."""
    c = F.col
    empty = F.lit("")
    cites = F.when(cited(c("derived_from")), F.concat(F.lit(" [cites "), F.size("derived_from").cast("string"), F.lit(" events]"))).otherwise(empty)
    anchor = F.when(c("basis").isNotNull(), F.concat(F.lit(" "), basis_label(c("basis")))).otherwise(empty)
    by_kind = {
        "meta": F.concat(clip(c("cwd"), most), F.lit(" "), F.coalesce("branch", empty)),
        "tool": F.concat(c("tool"), F.when(c("ok"), empty).otherwise(F.lit(" FAILED")), F.lit(" "), clip(c("detail"), most)),
        "file": clip(c("path"), most),
        "commit": F.concat(F.substring("hash", 1, 8), F.lit(" "), clip(c("message"), most)),
        "compacted": F.lit("— context window compacted —"),
        "obs": F.concat(c("subject"), F.lit(": "), clip(c("text"), most), cites, anchor),
    }
    return reduce(lambda e, kv: F.when(c("kind") == kv[0], kv[1]).otherwise(e), by_kind.items(), clip(c("text"), most))
