"""Vectorised text primitives over the UTF-8 buffers of Arrow string columns.

Everything here works on one bounded slice of a task's rows at a time: the bytes of the
slice as a uint8 array and the rows' offsets in it. Hashes scramble eight bytes at a time with
their place, so that no texts cancel by construction; they depend on content alone and agree
in every task of every run. Two lanes with different multipliers make wider hashes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one numpy pass takes at a time; a longer single text makes a slice of its own.
SLICE = 1 << 20
#: Words that one numpy pass takes at a time, likewise.
WORDS = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits of the result."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random number for each byte, for rolling hashes that decide places only.
TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(11)) | U(1)
#: Keeps 48 bits of a hash, for questions where a chance collision only costs a second look.
COARSE = U(0xFFFFFFFFFFFF0000)
#: Odd multipliers of the two independent lanes of a hash.
LANES = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))
#: Masks of the first 0 to 8 bytes of a little-endian load.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf, and from its end, as integers; zeros follow the last byte."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each span in loads of eight (the last one masked, at least one), each load's place in its span, and the spans' first loads."""
    n = ends - starts
    count = np.maximum((n + 7) >> 3, 1)
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(row)) - first[row]
    at = starts[row] + 8 * place
    return loads(buf)[at].astype(U) & FIRST[np.minimum(ends[row] - at, 8)], place, first


def _sum(x: np.ndarray, place: np.ndarray, first: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    """Each span's sum of its loads, each scrambled with its place: nothing cancels, as nothing is linear in a load."""
    if not len(first):
        return np.zeros(0, U)
    h = mix(x ^ mix(place.astype(U) * LANES[which] + U(which)))
    return mix(np.add.reduceat(h, first) + size.astype(U) * LANES[which])


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes buf[s:e] of each span; equal spans hash alike wherever they stand."""
    x, place, first = pieces(buf, starts, ends)
    return _sum(x, place, first, ends - starts, which)


def both_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """`span_hash` in both lanes."""
    x, place, first = pieces(buf, starts, ends)
    return [_sum(x, place, first, ends - starts, which) for which in (0, 1)]


def joined(a: np.ndarray, b: np.ndarray, salt: int, which: int = 0) -> np.ndarray:
    """Hash of a pair of hashes, in this order."""
    return mix(mix(a + U(salt)) * LANES[which] + b)


def windows(h: np.ndarray, at: np.ndarray, size: int, unit: int = 1, which: int = 0) -> np.ndarray:
    """Hash of the ``size`` values from each place, where h[i] stands for the ``unit`` values from i; by doubling."""
    n = unit
    while 2 * n <= size:
        h, n = joined(h[:-n], h[n:], n, which), 2 * n
    return joined(h[at], h[at + size - n], size, which)


def row_windows(h: np.ndarray, off: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """`windows` at ascending places that lie in one row each, slice by slice."""
    out = [np.zeros(0, U)]
    for lo, hi in slices(off, WORDS):
        mine = at[slice(*np.searchsorted(at, [off[lo], off[hi]]))] - off[lo]
        if len(mine):
            out.append(windows(h[off[lo] : off[hi]], mine, size, 1, which))
    return np.concatenate(out)


def runs(h: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of h[s : s + n] for spans that may overlap: each is read as stretches of powers of two, shortest first."""
    out = mix(counts.astype(U) * LANES[which])
    at, step = starts.copy(), 1
    while True:
        use = np.flatnonzero(counts & step)
        if len(use):
            out[use] = joined(out[use], h[at[use]], step, which)
            at[use] += step
        if not len(counts) or 2 * step > counts.max():
            return out
        h, step = joined(h[:-step], h[step:], step, which), 2 * step


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks, beside a JVM that needs it too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    col = batch.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the offsets of each row's words among them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[buf]
    edge = off[(off > 0) & (off < len(buf))]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[edge] = False
    starts = np.flatnonzero(solid & ~before)
    after = before
    after[-1], after[:-1] = False, solid[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, off: np.ndarray, lower: bool, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, row by row, and the offsets of each row's words."""
    hashes, counts = [np.zeros(0, U)], [np.zeros(1, np.int64)]
    base = 0
    for lo, hi in slices(off):
        part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        s, e, w = words(part, o)
        hashes.append(span_hash(LOWER[part] if lower else part, s, e, which))
        counts.append(w[1:] + base)
        base += len(s)
    return np.concatenate(hashes), np.concatenate(counts)


def groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, in ascending order of the values, and each place's number among them."""
    order = np.argsort(h)
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inv = np.empty(len(h), np.int64)
    inv[order] = np.cumsum(new) - 1
    return order[new], inv


def owners(off: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + n)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift
