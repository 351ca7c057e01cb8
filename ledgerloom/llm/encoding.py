"""Vectorised encoding of whole texts with a public tokenizer of the tokenizers library.

Texts are cut into pieces at ASCII white space, and inside words only where the tokenizer's own splitter always
cuts and no normalisation crosses: between two ASCII bytes of different kind (letter, digit, other) or after a digit,
neither of them an apostrophe. Pieces are looked up by hash in a cache of encoded pieces; new ones go to the
library. Slices that hold the text of a special token's opening are cut at white space only and keep their case.

The cache is bounded (``KEPT_BYTES`` of its arrays); when full it starts anew, which changes nothing but time. A batch of new
pieces beyond the bound is held for as long as its slice needs it.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .packed import LOWER, WORDS, Slice

KEPT_BYTES = 32 << 20
VOCABULARY = "word_bpe_49k.json"

_KIND = np.full(256, 4, np.uint8)  # 0 separator, 1 letter, 2 digit, 3 other ASCII, 4 beyond ASCII, 5 apostrophe
_KIND[:128] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 5
_KIND[:9] = _KIND[14:32] = _KIND[127] = 4  # control characters: the library decides


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> str:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    beyond = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(beyond)) for b in range(256))


class Encoder:
    def __init__(self, path: str, special: bool = True):
        """special: False takes the strings of special tokens in a text as ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.special = special
        self.model, self.letters = self.library.model, _byte_letters()
        self._reset()

    def _reset(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _bytes(self) -> int:
        return self.keys.nbytes + self.at.nbytes + self.size.nbytes + self.flat.nbytes

    def _piece(self, piece: bytes) -> list[int]:
        if piece.isalpha() and piece.islower():  # ASCII letters stand for themselves
            return [t.id for t in self.model.tokenize(piece.decode("ascii"))]
        text = piece.decode("utf-8", "replace")
        # one run of lower-case Latin letters is one pre-token: the model can take it as it is
        if text.isalpha() and max(text) < "ɐ" and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return [t.id for t in self.model.tokenize("".join(self.letters[b] for b in piece))]
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, keys: np.ndarray, pieces: list[bytes]):
        ids = [self._piece(p) for p in pieces]
        size = np.array([len(x) for x in ids], np.int32)
        flat = np.array([t for x in ids for t in x], np.uint32)
        keys = np.concatenate((self.keys, keys))
        at = np.concatenate((self.at, len(self.flat) + np.cumsum(size) - size))
        size = np.concatenate((self.size, size))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], at[order], size[order]
        self.flat = np.concatenate((self.flat, flat))

    def _cut(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and starts and ends of pieces."""
        if b"<|" in s.raw.tobytes():
            return s.raw, s.start, s.end
        buf = LOWER[s.raw]
        kind = _KIND[buf]
        a, b = kind[:-1], kind[1:]
        cut = (a == 0) | (b == 0) | (((a != b) | (a == 2)) & (a < 4) & (b < 4))
        edge = np.concatenate(([0], np.flatnonzero(cut) + 1, [len(buf)]))
        start, end = edge[:-1], edge[1:]
        full = kind[start] != 0 if len(buf) else np.zeros(0, bool)
        return buf, start[full], end[full]

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens of each document) of a slice."""
        if not len(s.raw):
            return np.zeros(0, np.uint32), np.zeros(len(s.ids), np.int64)
        buf, start, end = self._cut(s)
        h = WORDS.spans(WORDS.prefix(WORDS.bytes[buf]), start, end) + (end - start).astype(np.uint64)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if self._bytes() > KEPT_BYTES:
                self._reset()
                new[:] = True  # the known ones are needed too
            data = buf.tobytes()
            self._learn(keys[new], [data[start[i] : end[i]] for i in first[new]])
            at = np.searchsorted(self.keys, keys)
        place, size = self.at[at][which], self.size[at][which]
        total = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.arange(total[-1] if len(total) else 0) - np.repeat(total - size - place, size)]
        upto = np.concatenate(([0], total))
        return ids, np.diff(upto[np.searchsorted(start, s.byte)])
