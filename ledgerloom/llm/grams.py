"""Character n-grams of folded texts: lower case, everything ASCII that is no letter as a blank; documents never share a gram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .packed import batch_slices

_STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


class Folded:
    """Documents of a slice as code points, each with a zero after it."""

    def __init__(self, lens: np.ndarray, buf: np.ndarray):
        text = buf.tobytes().decode("utf-8", "replace")
        ends = np.cumsum(np.maximum(lens, 0) + 1) - 1  # of bytes
        if len(text) != len(buf):
            ends = np.cumsum((buf & 0xC0) != 0x80)[ends] - 1  # of characters
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case has another length: by document
            begins = np.concatenate(([0], ends[:-1] + 1))
            parts = [text[i:j].lower() + "\n" for i, j in zip(begins, ends, strict=True)]
            ends, low = np.cumsum([len(p) for p in parts]) - 1, "".join(parts)
        self.points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        other = (self.points < 128) & ~((self.points >= 97) & (self.points < 123))
        self.points[other] = 32
        self.points[ends] = 0
        self.bounds = np.concatenate(([0], ends + 1)).astype(np.int64)
        self.null = lens < 0

    def has_letter(self) -> np.ndarray:
        """Of each document: whether any character is a letter."""
        letters = np.concatenate(([0], np.cumsum((self.points >= 97) & (self.points < 123))))
        out = np.diff(letters[self.bounds]) > 0
        beyond = np.concatenate(([0], np.cumsum(self.points >= 128)))
        for d in np.flatnonzero(~out & (np.diff(beyond[self.bounds]) > 0)):
            out[d] = any(chr(c).isalpha() for c in np.unique(self.points[self.bounds[d] : self.bounds[d + 1]]).tolist())
        return out

    def codes(self, sizes: tuple[int, ...]) -> list[tuple[int, np.ndarray]]:
        """(n, code of the n-gram at each place). Codes up to n = 3 are the characters themselves, longer ones 64-bit hashes."""
        out, points = [], self.points.astype(np.uint64)
        code = np.zeros(len(points), np.uint64)
        for n in range(1, max(sizes) + 1):
            m = max(len(points) - n + 1, 0)
            code = (code[:m] << np.uint64(21)) | points[n - 1 :] if n <= 3 else code[:m] * _STEP + points[n - 1 :]
            if n in sizes:
                mark = {1: 3 << 62, 2: 1 << 63}.get(n, 0)
                out.append((n, code | np.uint64(mark) if mark else code if n == 3 else code * _STEP + np.uint64(n)))
        return out

    def of(self, codes: list[tuple[int, np.ndarray]], d: int) -> np.ndarray:
        """The codes of document d."""
        return np.concatenate([c[self.bounds[d] : max(self.bounds[d], self.bounds[d + 1] - n)] for n, c in codes])


def slots(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * _STEP) >> np.uint64(64 - bits)).astype(np.int64)


class Distinct:
    """Distinct values of an array by a table of last places; values that share a slot with another are told apart by sorting."""

    def __init__(self):
        self.place = np.zeros(1 << _TABLE_BITS, np.int32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        slot, at = slots(codes, _TABLE_BITS), np.arange(len(codes), dtype=np.int32)
        self.place[slot] = at
        won = self.place[slot]
        lost = codes[won] != codes
        return np.concatenate((codes[won == at], np.unique(codes[lost]))) if lost.any() else codes[won == at]


def folded_batches(batches):
    """(ids, slice) of Arrow batches whose first columns are doc_id and text."""
    for batch in batches:
        for ids, lens, buf in batch_slices(batch.column(0), batch.column(1)):
            yield ids, Folded(lens, buf)


def id_array(ids: np.ndarray, null: int) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == null)
