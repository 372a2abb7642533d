"""Words of texts as arrays: offsets and hashes, for operators on word n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from precis.llm.common import mix64, powers

#: Words are runs of digits, letters a-z after lower-casing A-Z, and all
#: characters beyond the byte range.
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_IN_WORD = np.array([48 <= i <= 57 or 97 <= i <= 122 or i >= 128 for i in range(256)])

_RUN = 1 << 17  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15
_POW = powers(_BASE, _RUN)
_INV = powers(pow(_BASE, -1, 1 << 64), _RUN)
_CODE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_GRAM = powers(0xD6E8FEB86659FD93, 64)


@dataclass
class Words:
    """Words of several texts: ``data`` holds the lower-cased bytes, word i lies
    at starts[i]:ends[i]; text j has the words first[j] to first[j + 1]."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, start: int, n: int) -> str:
        """n words from ``start`` on, with a space between."""
        return b" ".join(self.data[a:b] for a, b in zip(
            self.starts[start:start + n].tolist(), self.ends[start:start + n].tolist())).decode("utf-8", "replace")


def _hash_words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial of each word's bytes, finished with its length."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(int(np.searchsorted(ends, at + _RUN, "right")), i + 1)
        part = codes[at:ends[j - 1]]
        n = len(part)
        pow_, inv = (_POW, _INV) if n <= _RUN else (powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[part] * pow_[:n], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


def words_of(texts: list[bytes]) -> Words:
    data = b"\n".join(texts).translate(_LOWER)
    codes = np.frombuffer(data, np.uint8)
    edge = np.diff(_IN_WORD[codes].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return Words(data, starts, ends, _hash_words(codes, starts, ends), np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words (across texts too: the caller drops those)."""
    if len(hashes) < n:
        return hashes[:0]
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for j in range(n):
        out += hashes[j:len(hashes) - n + 1 + j] * _GRAM[j]
    return mix64(out)


def within(w: Words, n: int) -> np.ndarray:
    """Whether the run of n words from each word on stays in its text."""
    if len(w.hashes) < n:
        return np.zeros(0, bool)
    text = w.text_of
    return text[:len(text) - n + 1] == text[n - 1:]
