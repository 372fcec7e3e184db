"""Words and word shingles of a text as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text whose words are hashed at a time; a text is never cut.
SLICE = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 256
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], "u8")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word; ``data`` has eight bytes more than the texts."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)

    def chunk(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at].view("<u8")[:, 0] & _MASKS[np.minimum(left, 8)]

    h = mixed(chunk(at, length) ^ (length.astype("u8") * _STEP))
    rest, done = np.flatnonzero((length > 8) & (length <= LONG)), 8
    while len(rest):
        h[rest] = mixed(h[rest] * _STEP + chunk(at[rest] + done, length[rest] - done))
        done += 8
        rest = rest[length[rest] > done]
    for i in np.flatnonzero(length > LONG):
        h[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + length[i]].tobytes())
    return h


def word_hashes(texts: pa.Array, lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words between blanks, slice by slice of the texts, and where each text's begin; with ``lower``, A-Z count as a-z."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], "i8" if pa.types.is_large_string(texts.type) else "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    whole = np.frombuffer(texts.buffers()[2] or b"", "u1")
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
        edges = offsets[low : high + 1] - offsets[low]
        data = np.zeros(edges[-1] + 8, "u1")
        data[:-8] = whole[offsets[low] : offsets[high]]
        if lower:
            data = _LOWER[data]
        # A blank before the first byte, and one after the last; words end at the edges of texts, too.
        blank = np.ones(edges[-1] + 2, bool)
        blank[1:-1] = _BLANK[data[:-8]]
        first = blank[:-1] & ~blank[1:]
        last = ~blank[:-1] & blank[1:]
        first[edges], last[edges] = ~blank[1:][edges], ~blank[:-1][edges]
        at = np.flatnonzero(first)
        yield _hashes(data, at, np.flatnonzero(last) - at), np.searchsorted(at, edges)
        low = high


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, "u8")
    h = words[:n].copy()
    for i in range(1, size):
        h = h * _STEP + words[i : n + i]
    return mixed(h)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingles; fewer words than ``size`` make one shingle of all, marked by their number."""
    for words, edges in word_hashes(texts, lower=True):
        shingles = windows(words, size)
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if 0 < high - low < size:
                yield windows(words[low:high], high - low) ^ np.uint64(high - low)
            else:
                yield _distinct(shingles[low : max(low, high - size + 1)])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view("i8")
