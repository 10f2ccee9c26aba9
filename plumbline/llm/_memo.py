"""Token ids of short byte spans, asked for once per distinct span and Python worker."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from plumbline.llm import _text as T

#: Distinct spans that a worker remembers at most; places of the table of short spans, by the leading bits of a hash.
REMEMBER, BITS = 400_000, 18


class Memo:
    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], lower: bool = False) -> None:
        """``lower``: spans that differ in the case of A-Z alone have the same ids."""
        self.encode, self.lower = encode, lower
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        #: Spans of at most 16 bytes: their bytes as two numbers, their length (0: none) and their slot.
        self.short = (np.zeros(1 << BITS, T.U), np.zeros(1 << BITS, T.U), np.zeros(1 << BITS, np.uint8), np.zeros(1 << BITS, np.int64))

    def ids_of(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans one after another, and the offsets of each span's."""
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.slot) > REMEMBER:
            self.forget()
        if self.lower:
            buf = T.LOWER[buf]
        n = e - s
        x = T.loads(buf)
        a, b = x[s].astype(T.U) & T.FIRST[np.minimum(n, 8)], x[np.minimum(s + 8, e)].astype(T.U) & T.FIRST[np.clip(n - 8, 0, 8)]
        g = (T.mix(a + T.mix(b + n.astype(T.U))) >> T.U(64 - BITS)).astype(np.int64)
        first, second, size, slot = self.short
        use = slot[g]
        rest = np.flatnonzero((first[g] != a) | (second[g] != b) | (size[g] != n))
        if len(rest):
            use[rest] = self.slots(buf, s[rest], e[rest])
            keep = rest[n[rest] <= 16]
            keep = keep[np.unique(g[keep], return_index=True)[1]]
            at = g[keep]
            first[at], second[at], size[at], slot[at] = a[keep], b[keep], n[keep], use[keep]
        start = np.cumsum(self.size) - self.size
        return self.ids[T.ranges(start[use], self.size[use])], np.concatenate(([0], np.cumsum(self.size[use])))

    def slots(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The slot of each span; what is new is encoded."""
        lead, inv = distinct(buf, s, e)
        raw = buf.tobytes()
        span = [raw[a:b] for a, b in zip(s[lead].tolist(), e[lead].tolist(), strict=True)]
        new = [x for x in span if x not in self.slot]
        if new:
            got = self.encode(new)
            self.slot.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            self.size = np.concatenate([self.size, np.fromiter(map(len, got), np.int64, len(got))])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32)])
        return np.fromiter(map(self.slot.__getitem__, span), np.int64, len(span))[inv]


def distinct(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that stand for all spans of their bytes, and for each span the number of its own; told by hash and held against the bytes."""
    x, place, first = T.pieces(buf, s, e)
    h = T._sum(x, place, first, e - s, 0)
    lead, inv = T.groups(h)
    own = lead[inv]
    same = e - s == e[own] - s[own]
    if same.all():  # as many loads: each must equal its leader's
        row = np.repeat(np.arange(len(s)), np.diff(np.append(first, len(x))))
        same = x == x[first[own][row] + place]
    if same.all():
        return lead, inv
    number: dict[bytes, int] = {}
    raw = buf.tobytes()
    inv = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(s.tolist(), e.tolist(), strict=True)])
    return np.unique(inv, return_index=True)[1], inv
