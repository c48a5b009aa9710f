"""Words of whole texts as numpy arrays: spans, 64-bit hashes, hashes of word windows.

A word is a run of characters outside the ASCII white space 0x20, 0x09-0x0D;
its bytes are taken unchanged. Memory beyond the text itself is 8 bytes a word
per array.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from orderlens.llm.common import text_bytes

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20

_LONG = 256  # bytes of a word above which it is hashed alone
_WINDOW_BASE = np.uint64(0xD1342543DE82EF95)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (wrapping multiply and shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters_and_digits() -> np.ndarray:
    """Mask over all code points: categories L and N."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def folded_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of texts in lower case, with spaces for all but Unicode letters and digits.

    Combining accents are composed with their letters first; sharp s is written ss and
    a final sigma as any other, so that upper-cased copies are equal.
    """
    data, off = text_bytes(column)
    if not len(data) or data.max() < 0x80:
        return _FOLD[data], off
    column = column.cast(pa.large_string())
    if ((data == 0xCC) | (data == 0xCD)).any():
        # not Arrow's utf8_normalize, whose NFC leaves accents apart
        column = pa.array([t and unicodedata.normalize("NFC", t) for t in column.to_pylist()], pa.large_string())
    data, off = text_bytes(pc.utf8_lower(column))
    out = _FOLD[data]
    at = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[at] >= 0xE0) + (data[at] >= 0xF0)
    code = data[at] & (0x7F >> size).astype(np.uint8)
    code = code.astype(np.int32)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | data[at[more] + k] & 0x3F
    sign = ~_letters_and_digits()[code]
    for k in range(4):
        out[at[sign & (size > k)] + k] = 0x20
    sharp = at[code == 0xDF]
    out[sharp] = out[sharp + 1] = ord("s")
    out[at[code == 0x3C2] + 1] = 0x83
    return out, off


def unicode_space(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes of Unicode white space (``\\s`` of the tokenizers' patterns) in UTF-8 text."""
    out = SPACE[data]
    at = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    if len(at):
        a = data[at]
        b, c = data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        three |= (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        for k in range(3):
            out[at[three] + k] = True
        out[at[two]] = out[at[two] + 1] = True
    return out


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and for each row the index of its first word (n + 1 values).

    ``space`` marks the bytes between words (default: ASCII white space).
    """
    solid = ~(SPACE[data] if space is None else space)
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before &= ~edge[:n]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: its chunks of eight bytes go through a mixing step one after the other.

    Salts give independent hashes. Long words go through a 64-bit hash function one by one.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) ^ np.uint64(salt ^ 0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    chunks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    long = np.flatnonzero(size > _LONG)
    going = np.flatnonzero(size <= _LONG)
    for k in range(0, _LONG, 8):
        left = size[going] - k
        going, left = going[left > 0], left[left > 0]
        if not len(going):
            break
        drop = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        chunk = chunks[starts[going] + k] << drop
        out[going] = mix(out[going] ^ chunk) + np.uint64(0x9E3779B97F4A7C15)
    for w in long:
        out[w] = xxhash.xxh3_64_intdigest(data[starts[w]: ends[w]].tobytes(), salt & 0xFFFFFFFFFFFFFFFF)
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values of ``words`` (rows are not told apart)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(_powers(_WINDOW_BASE, width)):
        out += words[k: k + n] * p
    return mix(out)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Mask over all word positions (less ``width - 1``): the window stays inside one row."""
    n = int(first[-1])
    ok = np.ones(max(0, n - width + 1), bool)
    for e in first[1:-1]:
        ok[max(0, e - width + 1): e] = False
    return ok
