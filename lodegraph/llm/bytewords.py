"""Words of many texts at once, found and hashed on their UTF-8 bytes with numpy.

The hash of a span of bytes is a polynomial over a random table of byte values modulo 2**64: one pass of
prefix sums gives the hashes of all spans, and a final mix spreads them. Work goes in blocks cut between
spans, so memory follows the block and the longest span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240607))
TABLES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK)
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size == 2 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def lower_map() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte_map: np.ndarray, checks: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Hash of each span; with checks a second, independent one too."""
    n = len(starts)
    out = [np.zeros(n, np.uint64) for _ in range(1 + checks)]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        part = byte_map[data[lo:hi]]
        for k in range(1 + checks):
            total = np.empty(hi - lo + 1, np.uint64)
            total[0] = 0
            weighted = TABLES[k][part]
            weighted *= _power(_BASES[k], hi - lo)
            np.cumsum(weighted, out=total[1:])
            h = total[e] - total[s]
            h *= _power(pow(_BASES[k], -1, 1 << 64), hi - lo + 1)[s]
            h += (e - s).astype(np.uint64)
            out[k][at:to] = mix(h)
        at = to
    return (out[0], out[1]) if checks else out[0]


def runs(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start byte, end byte) of every maximal run of word bytes within a text, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[data]
    change = np.empty(len(data) + 1, bool)
    change[0], change[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    edges = np.flatnonzero(change)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = np.unique(inner[inside[inner] & inside[inner - 1]])  # a run never crosses from one text to the next
    if len(inner):
        edges = np.sort(np.concatenate((edges, inner, inner)))
    start, end = edges[0::2], edges[1::2]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, byte_map: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start byte, end byte, hash) of every word. is_word: 256 booleans; byte_map: lower-casing."""
    row, start, end = runs(data, offsets, is_word)
    return row, start, end, spans(data, start, end, byte_map)
