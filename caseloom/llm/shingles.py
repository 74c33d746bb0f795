"""Word shingles as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SLICE = 1 << 19


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[list(_SPACES)] = False
_POWER = np.ones(1, np.uint64)
_PLACE = _mixed(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        _POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024), 0x9E3779B97F4A7C15, np.uint64)]))
    return _POWER


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) and how many each text has."""
    data, offsets = _bytes(texts)
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets)) if len(starts) else np.zeros(len(texts), np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    letters = _LOWER[data[inside]]
    first = np.cumsum(inside)[starts] - 1
    length = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, length)
    return _mixed(np.add.reduceat(_BYTE[letters] * _powers(int(length.max()))[place], first)), counts


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of some 500 kB, with the index of the first."""
    sizes = np.diff(_bytes(texts)[1])
    run = np.cumsum(sizes) // _SLICE
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        if b > a:
            yield a, texts.slice(a, b - a)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-word shingles, ascending; of fewer words the whole as one; without words none."""
    for _, part in slices(texts):
        h, counts = words(part)
        ends = np.cumsum(counts)
        if len(h) >= n:
            all_ = np.zeros(len(h) - n + 1, np.uint64)
            for j in range(n):
                all_ += h[j : len(h) - n + 1 + j] * _PLACE[j]
            all_ = _mixed(all_)
        for end, c in zip(ends.tolist(), counts.tolist(), strict=True):
            if c >= n:
                yield np.unique(all_[end - c : end - n + 1])
            elif c:
                short = np.append(h[end - c : end] * _PLACE[:c], _PLACE[62:63] ^ np.uint64(c))
                yield _mixed(np.add.reduce(short, keepdims=True))
            else:
                yield np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs."""
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(v - (1 << 64) if v >> 63 else v for v in (x >> 64, x & ((1 << 64) - 1)))
