"""Word shingles of many texts at once, as 64-bit hashes in flat numpy arrays.

A word's hash is a polynomial over its bytes, taken from prefix sums over the joined texts, so that no Python object
is made for a word. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Parameters of the hash: any odd base has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (two xor-shift-multiply rounds)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    name = str(base)
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, 1 << 16), base, dtype=U)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:n]


def chunks(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `limit` bytes, so that the flat arrays stay small; a longer text is a run of its own."""
    run: list[bytes] = []
    begin, held = 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if run and held + len(b) > limit:
            yield begin, run
            begin, run, held = i, [], 0
        run.append(b)
        held += len(b)
    if run:
        yield begin, run


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of each word of the texts, in order."""
    data = np.frombuffer(b" ".join(run) + b" ", dtype=np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    value = _BYTE[data]
    value[space] = 0
    value *= _power(BASE, len(data))
    prefix = np.empty(len(data) + 1, dtype=U)
    prefix[0] = 0
    np.cumsum(value, out=prefix[1:])
    h = (prefix[ends] - prefix[begins]) * _power(INVERSE, len(data))[begins]
    starts = np.cumsum([0, *(len(b) + 1 for b in run[:-1])])
    return mix(h), np.searchsorted(starts, begins, side="right") - 1


def shingle_hashes(run: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of each shingle of `width` words. A shorter text with words has one: all its words."""
    word, doc = word_hashes(run)
    parts = mix(np.arange(1, width + 1, dtype=U) * U(BASE) ^ U(0x5851F42D4C957F2D)) | U(1)
    whole = max(0, len(word) - width + 1)
    total = np.zeros(whole, dtype=U)
    for j, m in enumerate(parts):
        total += word[j : j + whole] * m
    inside = doc[:whole] == doc[width - 1 :] if whole else np.zeros(0, dtype=bool)
    h, d = mix(total[inside]), doc[:whole][inside]
    count = np.bincount(doc, minlength=len(run))
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.r_[0, np.cumsum(count)[:-1]]
        extra = []
        for i in short.tolist():
            x = U(0)
            with np.errstate(over="ignore"):
                for j in range(count[i]):
                    x = x + word[first[i] + j] * parts[j]
            extra.append(x)
        h, d = np.r_[h, mix(np.array(extra, dtype=U))], np.r_[d, short]
    return h, d


def distinct(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, count) of the distinct shingles, sorted by text and hash."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.r_[at, len(h)])


def word_key(text: str | None) -> bytes:
    """128 bits that name the sequence of words; texts that differ in white space only share it."""
    return hashlib.blake2b(b" ".join((text or "").encode("utf-8", "surrogatepass").split()), digest_size=16).digest()
