"""Vectorised hashing of words, k-grams and windows inside a task.

All texts of an Arrow slice are handled as one byte buffer with document
bounds; no function lets a word, k-gram or window cross a document. Hashes are
64-bit, depend on the content alone (never on the slice or the task) and are
used to choose and to group; operators that must be exact compare the content
or a 128-bit hash afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
_SHIFT = U64(33)
_MIX_A, _MIX_B = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
GRAM_BASE, WINDOW_BASE, SECOND_BASE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
_WORD_BASE = U64(0xE7037ED1A0B428DB)
#: Low bits of a packed k-gram hash that hold its place in a tile.
PLACE_BITS = 24
#: Windows handled at a time: bounds the memory whatever the length of a text.
TILE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> _SHIFT)
    x = x * _MIX_A
    x ^= x >> _SHIFT
    x = x * _MIX_B
    x ^= x >> _SHIFT
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * GRAM_BASE)


def separator_table(is_separator) -> np.ndarray:
    return np.array([bool(is_separator(b)) for b in range(256)])


#: Words are runs of bytes other than space and \x09-\x0D.
BLANK = separator_table(lambda b: b == 32 or 9 <= b <= 13)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices of at most ``limit`` text bytes, or of one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and len + 1 bounds. Null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_spans(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = BLANK):
    """Byte starts and ends of all words, and the bounds of documents in words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = ~separators[data]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def _powers(base: U64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=U64)
    p[0] = 1
    return np.cumprod(p, dtype=U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes."""
    out = np.empty(len(starts), U64)
    step = 1 << 16
    powers = _powers(_WORD_BASE, int((ends - starts).max()) if len(starts) else 1)
    for i in range(0, len(starts), step):
        s, e = starts[i:i + step], ends[i:i + step]
        size = e - s
        heads = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(heads, size)
        values = BYTE_CODES[data[place + np.repeat(s, size)]] * powers[place]
        out[i:i + step] = np.add.reduceat(values, heads) + size.astype(U64)
    return mix(out)


def gram_hashes(units: np.ndarray, k: int, base: U64) -> np.ndarray:
    """Hash of the k units from each place on (n - k + 1 of them), not yet mixed."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total, taken, power = None, 0, units
    width, factor, scale = 1, int(base), 1
    while True:
        if k & width:
            part = power[taken:taken + n] * U64(scale)
            total = part if total is None else total + part
            taken += width
            scale = scale * factor & _MASK
        width *= 2
        if width > k:
            return total
        power = power[:-(width // 2)] + power[width // 2:] * U64(factor)
        factor = factor * factor & _MASK


def sliding_minimum(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours (n - w + 1 of them)."""
    width = 1
    while width * 2 <= w:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = w - width
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def window_anchors(units: np.ndarray, bounds: np.ndarray, k: int, length: int):
    """For tiles of window starts: (starts, anchors), the starts of all windows of
    ``length`` units inside one document and the place of each one's anchor.

    The anchor of a window is the leftmost of its k-grams with the smallest
    hash (winnowing). Windows of equal content have it at the same offset, so
    that equal windows always meet under the k-gram of their anchor.
    """
    sizes = np.diff(bounds)
    long = sizes >= length
    if not long.any():
        return
    last = np.zeros(len(units) + 1, np.int8)  # +1 where valid starts begin, -1 where they end
    np.add.at(last, bounds[:-1][long], 1)
    np.add.at(last, bounds[1:][long] - length + 1, -1)
    valid = np.cumsum(last[:-1], dtype=np.int8).view(bool)
    low = U64((1 << PLACE_BITS) - 1)
    for at in range(0, len(units) - length + 1, TILE):
        here = units[at:at + TILE + length - 1]
        starts = np.flatnonzero(valid[at:at + len(here) - length + 1])
        if not len(starts):
            continue
        packed = mix(gram_hashes(here, k, GRAM_BASE))
        packed &= ~low
        packed |= np.arange(len(packed), dtype=U64)
        least = sliding_minimum(packed, length - k + 1)[starts]
        yield starts + at, (least & low).astype(np.int64) + at


def hash_at(units: np.ndarray, places: np.ndarray, k: int, base: U64) -> np.ndarray:
    """Mixed hash of the k units from each of a few places on."""
    if not len(places):
        return np.zeros(0, U64)
    total, scale = np.zeros(len(places), U64), 1
    for j in range(k):
        total += units[places + j] * U64(scale)
        scale = scale * int(base) & _MASK
    return mix(total)


def covered(places: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` units lie in a window of ``length`` units from one of the places on."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


def signed(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes).view(np.int64)
