"""Vectorised work on the bytes of whole Arrow string arrays: words, word hashes, document boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = bytes([0x20, 9, 10, 11, 12, 13])
#: Bytes handled at a time; a longer text is cut at separators, so memory stays bounded by the longest word.
SLICE = 1 << 18


def _table(is_word) -> tuple[np.ndarray, np.ndarray]:
    """(byte belongs to a word, random value of the lower-cased byte) by byte value."""
    values = np.random.default_rng(20240117).integers(0, 2**64, 256, dtype=np.uint64)
    values[65:91] = values[97:123]  # A-Z count as a-z
    return np.array([is_word(b) for b in range(256)]), values


SPACED, SPACED_VALUES = _table(lambda b: b not in _SPACE)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    buffers = arr.buffers()
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def fmix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply rounds)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_M = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of an odd multiplier and of its inverse, modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_M, -1, 2**64)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, m, np.uint64)]), dtype=np.uint64) for m in (_M, inverse))
        return self.up, self.down


_powers = _Powers()


def _hash_range(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in data and where each begins and ends; cuts are positions at which a word ends anyway."""
    word = SPACED[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= word[cuts]
    last[cuts - 1] |= word[cuts - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(SPACED_VALUES[data] * up[: len(data)], out=total[1:])
    return fmix((total[b] - total[a]) * down[a]), a, b


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SLICE bytes that never cut a word."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + SLICE, end)
        if to < end:
            d = int(np.searchsorted(offsets, to, "right")) - 1  # whole documents where possible
            if offsets[d] > at:
                to = int(offsets[d])
            else:
                while to < end and SPACED[data[to]] and to not in offsets[d + 1 : d + 2]:
                    to += 1
        yield at, to
        at = to


def hash_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes, begins, ends) of all words of texts given as bytes and offsets."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in _slices(data, offsets):
        h, p, q = _hash_range(data[a:b], offsets[(offsets > a) & (offsets < b)] - a)
        parts.append((h, p + a, q + a))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def hashed_words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of every text, word offsets by text); words are lower-cased in A-Z only."""
    data, offsets = text_bytes(arr)
    hashes, begins, _ = hash_spans(data, offsets)
    return hashes, np.searchsorted(begins, offsets)


#: Words of the decontamination contract: runs of digits, letters a-z (after lower-casing A-Z) and non-ASCII bytes.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(ALNUM).split() if text else []
