"""Vectorised words of UTF-8 text held in Arrow buffers.

A word is a run of bytes that are ASCII digits or letters or belong to a code
point of 128 or more; A-Z are lower-cased. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_b = np.arange(256)
IS_WORD = ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Values of bytes in hashes: as they are, and with A-Z as a-z.
EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_BYTE = EXACT[LOWER]
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n + 1:
        k = max(n, 2 * PIECE) + 1
        _pow[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(k - 1, r)])) for r in (_R, _R_INV)]
    return _pow[0], _pow[1]


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_binary()) if text.null_count == 0 else text.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(data: np.ndarray, off: np.ndarray, is_in: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs with ``is_in`` true, cut at texts' borders,
    and n + 1 positions of each text's first run."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = is_in.copy()
    first[1:] &= ~is_in[:-1] | edge[1:n]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each run's bytes, by ``table`` lower-cased; runs begin in ascending order."""
    out = np.empty(len(s), np.uint64)
    a = 0
    while a < len(s):
        b = max(a + 1, int(np.searchsorted(s, s[a] + PIECE)))
        lo, hi = int(s[a]), max(int(s[b - 1]), int(e[b - 1]))
        pw, inv = _powers(int(hi - lo))
        c = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * pw[: hi - lo], out=c[1:])
        x, y = s[a:b] - lo, e[a:b] - lo
        out[a:b] = mix((c[y] - c[x]) * inv[x] + (y - x).astype(np.uint64))
        a = b
    return out


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and n + 1 positions of each text's first."""
    data, off = buffers(text)
    s, e, at = spans(data, off, IS_WORD[data])
    return hashes(data, s, e), at


def pieces(batch: pa.RecordBatch | pa.Table, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of whole rows with about ``most`` bytes of text each, one row at least."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, a = np.concatenate([[0], np.cumsum(size)]), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b
