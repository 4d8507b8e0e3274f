"""Words, word hashes and shingles of many texts at once, on their UTF-8 bytes.

Works inside tasks on Arrow buffers. Memory follows the block of texts given
(``blocks`` keeps blocks near a fixed number of bytes; a longer text is a block
of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_STEP = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)], np.uint64)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their bytes and offsets (from 0); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base & _MASK, np.uint64)
            steps[0] = 1
            _POWERS[at] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order."""
    ink = ~_SPACE[raw]
    before = np.empty_like(ink)
    before[:1] = False
    before[1:] = ink[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    before[heads] = False
    after = np.empty_like(ink)
    after[-1:] = False
    after[:-1] = ink[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``width`` words; a shorter text has one run of all its words."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.concatenate([rows, np.full(width, -1, rows.dtype)])
    total = np.zeros(n, np.uint64)
    for k in range(width):
        same = padded[k : n + k] == rows
        part = np.zeros(n, np.uint64)
        part[: n - k] = hashes[k:] if k < n else 0
        total += np.where(same, part * _STEP[k], np.uint64(0))
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = rows[1:] != rows[:-1]
    whole = (padded[width - 1 : n + width - 1] == rows) | first
    return mix(total[whole]), rows[whole]


def occurrence(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each shingle, how many equal ones its row has before it in sorted order (0, 1, ...)."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.empty(len(h), bool)
    new[:1] = True
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(h))
    nth = np.empty(len(h), np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return nth
