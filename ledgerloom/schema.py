"""The event ledger's row, its kinds, and the fixed sizes of its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_VERSION = 3
BASIS = "struct<commit:string,dirty:boolean>"

PAYLOAD = {
    "cwd": "string", "branch": "string", "embed_version": "string", "text": "string", "tool": "string", "detail": "string", "ok": "boolean",
    "path": "string", "hash": "string", "message": "string", "subject": "string", "derived_from": "array<bigint>", "basis": BASIS,
}
KEY = {"session": "string", "seq": "bigint", "v": "int", "ts_ms": "bigint", "kind": "string"}
COLUMNS = KEY | PAYLOAD
EVENT_DDL = ", ".join(f"{n} {t}" for n, t in COLUMNS.items())
LOG_DDL = EVENT_DDL + ", ingest_batch bigint, ingest_ord bigint"

# Sizes in bytes of UTF-8, and the layout of sequence numbers.
USER_BYTES = 2048
FINAL_BYTES = 8192
SAID_BYTES = 1200
SAID_LEAST = 80
DETAIL_BYTES = 500
MESSAGE_BYTES = 200
EMBED_USER_BYTES = 400
STRIDE = 16
FIRST_OBS_SEQ = 1 << 31
HOOK_FINAL_SEQ = (1 << 31) - 1
DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def conform(df: DataFrame) -> DataFrame:
    """``df`` with all columns of an event: missing ones are null (the version is the current one)."""
    have = set(df.columns)
    default = lambda n: F.lit(EVENT_VERSION) if n == "v" else F.lit(None)
    return df.select(*((F.col(n) if n in have else default(n)).cast(t).alias(n) for n, t in COLUMNS.items()))
