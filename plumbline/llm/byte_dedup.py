"""Removal of repeated byte strings by prefix-free parsing (operator 8).

Rolling-hash triggers (every position whose next few bytes hash to zero modulo a constant)
cut each text into overlapping phrases; a phrase depends on its own bytes alone, so a string
that repeats is parsed alike wherever it stands, apart from its two ends.

1. A phrase that occurs once in the corpus cannot lie in a repeat: one pass over the phrases
   leaves alive only the strings of ``length`` bytes that hold no such phrase.
2. A live string is told by the parse: its core (its first to its last trigger) and the
   frame, which is the core with the phrases on either side. One pass finds for every frame
   its earliest place in corpus order and for every core the number of its different frames.
   A string in a later occurrence of a frame is a repeat. So is none in the first occurrence
   of the only frame of its core.
3. What is left are the ends of repeats, where frames of one core differ, and strings without
   any trigger. Their bytes are hashed one by one, and the earliest place of each is found.

Frames and strings, whose verdict removes text, are told by 96 bits of two lanes of hashes.

The corpus order is doc_id, then place in the text. Every question is put to the whole corpus
by bounded blocks through `_tally`.

The suffix arrays that prefix-free parsing usually merges in the last step are not built: to
remove repeats of one fixed length only the classes of equal strings and the earliest member
of each are needed, not the order between classes, and these come out of the parse by hashes
without a sort of all suffixes.

Cases: null text is empty; copies of a text are folded into the smallest doc_id, whose copies
lose everything if they have ``length`` bytes; rows with one doc_id are one document whose texts are
told apart by place alone; a null doc_id
counts as the largest; a very long text is one slice of its block and read whole; extra columns
are ignored; an empty table returns no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _tally as Q
from plumbline.llm import _text as T
from plumbline.llm._stage import Stage, buckets, distinct_texts, keyed
from plumbline.llm.substring_dedup import LAST, _order

LENGTH, TRIGGER, MODULUS = 100, 8, 16
PHRASE, FRAME, CORE, STRING, LEFT = 1, 2, 3, 4, 5


def triggers(buf: np.ndarray, off: np.ndarray, modulus: int) -> np.ndarray:
    """Positions whose next TRIGGER bytes lie in one row and hash to the least of ``modulus`` equal ranges."""
    if len(buf) < TRIGGER:
        return np.zeros(0, np.int64)
    h = T.loads(buf)[: len(buf) - TRIGGER + 1] * T.LANES[0]
    h ^= h >> T.U(29)
    h *= T.LANES[1]
    at = np.flatnonzero(h < T.U((1 << 64) // modulus))
    row = np.searchsorted(off, at, "right") - 1
    return at[at + TRIGGER <= off[row + 1]]


class Slice:
    """One numpy pass's texts with their triggers. Names are pairs of hashes, one of each lane."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, length: int) -> None:
        self.buf, self.off, self.length = buf, off, length
        self.at = triggers(buf, off, MODULUS)
        self.row = np.searchsorted(off, self.at, "right") - 1
        #: The triggers that another one of the row follows: a phrase goes from one to the end of the next.
        self.one = np.flatnonzero(self.row[1:] == self.row[:-1]) if len(self.at) else np.zeros(0, np.int64)
        self.names: tuple[np.ndarray, ...] = ()

    def phrases(self) -> np.ndarray:
        """The phrases' names, cut to the bits that the sieve asks about."""
        if not self.names:
            got = T.both_hashes(self.buf, self.at[self.one], self.at[self.one + 1] + TRIGGER)
            self.names = tuple(np.zeros(len(self.at), T.U) for _ in got)
            for full, x in zip(self.names, got, strict=True):
                full[self.one] = x
        return self.names[0][self.one] & T.COARSE

    def alive(self, alone: np.ndarray) -> np.ndarray:
        """Starts of the strings that hold no phrase flagged as alone."""
        n = len(self.buf)
        full = np.maximum(np.diff(self.off) - self.length + 1, 0)
        s, e = self.at[self.one][alone], self.at[self.one + 1][alone] + TRIGGER
        first = np.maximum(e - self.length, self.off[self.row[self.one][alone]])
        ok = first <= s
        count = np.bincount(np.concatenate([self.off[:-1] + full, first[ok]]), minlength=n + 1)
        count -= np.bincount(np.concatenate([self.off[1:], s[ok] + 1]), minlength=n + 1)
        return np.flatnonzero(np.cumsum(count[:n]) == 0)

    def framed(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last trigger inside each string; the last is before the first where there is none."""
        before = np.zeros(len(self.buf) + 2, np.int32)
        before[self.at + 1] = 1
        np.cumsum(before, out=before)
        return before[start].astype(np.int64), before[start + self.length - TRIGGER + 1].astype(np.int64) - 1

    def frames(self, a: np.ndarray, b: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Names of the cores and frames from trigger a to trigger b, and where the frames start."""
        self.phrases()
        row, last = self.row[a], len(self.at) - 1
        inside = (a > 0) & (self.row[a - 1] == row)
        more = (b < last) & (self.row[np.minimum(b + 1, last)] == row)
        left = np.where(inside, self.at[a - 1], self.off[row])
        # the stretches before a row's first trigger and after its last one
        rows, i = np.unique(self.row, return_index=True)
        j = np.append(i[1:], len(self.at)) - 1
        heads, tails = T.both_hashes(self.buf, self.off[rows], self.at[i]), T.both_hashes(self.buf, self.at[j] + TRIGGER, self.off[rows + 1])
        mine = np.searchsorted(rows, row)
        trigger = T.loads(self.buf)[self.at[a]].astype(T.U)
        cores, frames = [], []
        for lane, (name, head, tail) in enumerate(zip(self.names, heads, tails, strict=True)):
            core = T.joined(T.runs(name, a, b - a, lane), trigger, 1, lane)
            frame = T.joined(core, np.where(inside, name[a - 1], head[mine]), 2, lane)
            cores.append(core)
            frames.append(T.joined(frame, np.where(more, name[b], tail[mine]), 3, lane))
        return cores, frames, left

    def strings(self, start: np.ndarray) -> list[np.ndarray]:
        """Names of the strings of ``length`` bytes from these places, from the bytes that they cover alone."""
        if not len(start):
            return [np.zeros(0, T.U)] * 2
        cover = np.bincount(start, minlength=len(self.buf) + 1) - np.bincount(start + self.length, minlength=len(self.buf) + 1)
        held = np.cumsum(cover[:-1]) > 0
        at = np.concatenate(([0], np.cumsum(held)))[start]
        x = T.loads(self.buf[held])
        return [T.windows(x, at, self.length, TRIGGER, lane) for lane in (0, 1)]


def _slices(t: pa.Table, length: int) -> list[tuple[int, int, Slice]]:
    buf, off = T.bytes_of(t["text"])
    return [(lo, hi, Slice(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], length)) for lo, hi in T.slices(off)]


def _least(order: np.ndarray, first: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest (doc, at) of each run of entries that begins at first."""
    if not len(first):
        return doc[:0], at[:0]
    doc, at = doc[order], at[order]
    d = np.minimum.reduceat(doc, first)
    size = np.diff(np.append(first, len(order)))
    return d, np.minimum.reduceat(np.where(doc == np.repeat(d, size), at, LAST), first)


def _earliest(group: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Each entry's group's earliest (doc, at)."""
    order = np.argsort(group, kind="stable")
    new = np.ones(len(group), bool)
    new[1:] = np.diff(group[order]) != 0
    number = np.empty(len(group), np.int64)
    number[order] = np.cumsum(new) - 1
    return [x[number] for x in _least(order, np.flatnonzero(new), doc, at)]


def _check(names: list[np.ndarray]) -> np.ndarray:
    """32 bits of the second lane, which tell apart what collides in the first."""
    return (names[1] >> T.U(32)).astype(np.int64)


def _cat(parts_: list[np.ndarray], dtype: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *parts_])


def classes(texts: DataFrame, stage: Stage, length: int = LENGTH) -> DataFrame:
    """Per distinct text: k, m, n_bytes, spans (removed [start, end) pairs, flat), kept, for its smallest doc_id m."""
    n = buckets(texts.sparkSession)

    def ask_phrases(key: tuple, t: pa.Table) -> pa.Table:
        T.release()
        uniq, c = np.unique(_cat([s.phrases() for _, _, s in _slices(t, length)], T.U), return_counts=True)
        return Q.table_of(list(Q.asks(key[0].as_py(), PHRASE, uniq, [np.minimum(c, 2)], n)))

    def again(kind: int, group: np.ndarray, vals: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        return [(Q.sums(group, vals[0]) > 1)[group].astype(np.int64)], []

    def live_frames(t: pa.Table, slices: list, lone: np.ndarray) -> list[tuple]:
        """Per slice its first row, the live strings, whether they hold triggers and which frame is theirs; the frames' cores, names, document and start."""
        order, used, out = _order(t), 0, []
        for lo, _, s in slices:
            start = s.alive(lone[used : used + len(s.one)])
            used += len(s.one)
            a, b = s.framed(start)
            held = a <= b
            a, b = a[held], b[held]
            new = np.ones(len(a), bool)  # neither trigger goes back from one string to the next
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b = a[new], b[new]
            core, frame, left = s.frames(a, b) if len(a) else ([np.zeros(0, T.U)] * 2, [np.zeros(0, T.U)] * 2, a)
            row = s.row[a]
            out.append((lo, s, start, held, np.cumsum(new) - 1, core[0], frame, order[lo + row], left - s.off[row]))
        return out

    def lone_phrases(slices: list, r: pa.Table) -> np.ndarray:
        _, inv = T.groups(_cat([s.phrases() for _, _, s in slices], T.U))
        return Q.replies(r, PHRASE)[inv] == 0

    def entries(found: list, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and checks of names that stand in place ``at`` of each slice's answer."""
        lanes = [_cat([x[at][i] for x in found], T.U) for i in (0, 1)]
        return lanes[0], _check(lanes)

    def ask_frames(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        T.release()
        t = t.sort_by("k")  # flags of phrases are kept for later passes, where rows may come in another order
        slices = _slices(t, length)
        lone = lone_phrases(slices, r)
        got = live_frames(t, slices, lone)
        core, (frame, check) = _cat([x[5] for x in got], T.U), entries(got, 6)
        order, first, _ = Q.pairs(frame, check)
        lead, block = order[first], key[0].as_py()
        out = list(Q.asks(block, FRAME, frame[lead], [*_least(order, first, _cat([x[7] for x in got]), _cat([x[8] for x in got])), check[lead]], n))
        # a core is told how many frames it has: by the least and the greatest of their names
        order, names = np.argsort(core), (frame >> T.U(2)).astype(np.int64)
        ranked = core[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(core) else order
        ends = [f.reduceat(names[order], first) if len(core) else names for f in (np.minimum, np.maximum)]
        out += Q.asks(block, CORE, ranked[first], ends, n)
        out.append({"block": block, "bucket": -1, "kind": LEFT, "n": len(lone), "keys": None, "vals": [Q.pack(np.packbits(lone))]})
        return Q.table_of(out)

    def settle(kind: int, group: np.ndarray, vals: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        if kind == FRAME:
            return _earliest(Q.finer(group, vals[2]), vals[0], vals[1]), []
        least = Q.minima(group, vals[0])
        greatest = -Q.minima(group, -vals[1])
        return [(least != greatest)[group].astype(np.int64)], []

    def split(t: pa.Table, r: pa.Table) -> list[tuple]:
        """Per slice: its first row, the live strings known to be repeats, those whose bytes must be compared, and their names."""
        lone = np.unpackbits(Q.replies(r, LEFT).astype(np.uint8)).astype(bool)
        got = live_frames(t, _slices(t, length), lone)
        _, _, fi = Q.pairs(*entries(got, 6))
        _, ci = T.groups(_cat([x[5] for x in got], T.U))
        doc, at, several = Q.replies(r, FRAME, 0), Q.replies(r, FRAME, 1), Q.replies(r, CORE)
        used, out = 0, []
        for lo, s, start, held, inv, core, _, own, left in got:
            mine = slice(used, used + len(core))
            used += len(core)
            later = (doc[fi[mine]] < own) | (doc[fi[mine]] == own) & (at[fi[mine]] < left) if len(core) else np.zeros(0, bool)
            differ = ~later & (several[ci[mine]] == 1) if len(core) else later
            known, open_ = np.zeros(len(start), bool), ~held
            known[held], open_[held] = later[inv], differ[inv]
            out.append((lo, s, start[known], start[open_], s.strings(start[open_])))
        return out

    def strings(t: pa.Table, got: list) -> tuple[np.ndarray, ...]:
        """Keys, checks, documents and places of the strings to compare."""
        order = _order(t)
        rows = [np.searchsorted(s.off, o, "right") - 1 for _, s, _, o, _ in got]
        doc = _cat([order[x[0] + r] for x, r in zip(got, rows, strict=True)])
        at = _cat([x[3] - x[1].off[r] for x, r in zip(got, rows, strict=True)])
        return *entries(got, 4), doc, at

    def ask_strings(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        T.release()
        t = t.sort_by("k")
        keys, check, doc, at = strings(t, split(t, r))
        order, first, _ = Q.pairs(keys, check)
        lead = order[first]
        return Q.table_of(list(Q.asks(key[0].as_py(), STRING, keys[lead], [*_least(order, first, doc, at), check[lead]], n)))

    def settle_strings(kind: int, group: np.ndarray, vals: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        return _earliest(Q.finer(group, vals[2]), vals[0], vals[1]), []

    def remove(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        T.release()
        t = t.sort_by("k")
        got = split(t, r)
        keys, check, own, place = strings(t, got)
        _, _, inv = Q.pairs(keys, check)
        doc, at = Q.replies(r, STRING, 0), Q.replies(r, STRING, 1)
        later = (doc[inv] < own) | (doc[inv] == own) & (at[inv] < place) if len(keys) else np.zeros(0, bool)
        n_bytes, spans, kept, used = [], [], [], 0
        for _, s, known, open_, _ in got:
            starts = np.concatenate([known, open_[later[used : used + len(open_)]]])
            cover = np.bincount(starts, minlength=len(s.buf) + 1) - np.bincount(starts + length, minlength=len(s.buf) + 1)
            used += len(open_)
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            cut = _cut(edge, s.off)
            left = np.concatenate(([0], np.cumsum(~gone)))[s.off]
            data = s.buf[~gone].tobytes()
            for i in range(len(s.off) - 1):
                n_bytes.append(int(s.off[i + 1] - s.off[i]))
                spans.append(cut[i])
                kept.append(data[left[i] : left[i + 1]])
        return pa.table({"k": t["k"], "m": t["m"], "n_bytes": pa.array(n_bytes, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})

    blocks = texts.groupBy("block")
    shared = stage.table("phrases", Q.answers(blocks.applyInArrow(ask_phrases, Q.ASK), again))
    asked = stage.table("frames", blocks.cogroup(shared.groupBy("block")).applyInArrow(ask_frames, Q.ASK))
    stage.drop("phrases")
    framed = stage.table("framed", Q.answers(asked.filter("bucket >= 0"), settle).unionByName(asked.filter("bucket < 0")))
    stage.drop("frames")
    ends = stage.table("strings", Q.answers(blocks.cogroup(framed.groupBy("block")).applyInArrow(ask_strings, Q.ASK), settle_strings))
    return blocks.cogroup(framed.unionByName(ends).groupBy("block")).applyInArrow(remove, "k binary, m long, n_bytes long, spans array<long>, kept binary")


def _cut(edge: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """Removed spans (flat starts and ends over all rows) as each row's own, cut at its ends."""
    lo, hi = edge[0::2], edge[1::2]
    out = []
    a = np.searchsorted(hi, off[:-1], "right")
    b = np.searchsorted(lo, off[1:], "left")
    for i in range(len(off) - 1):
        x = np.stack([lo[a[i] : b[i]], hi[a[i] : b[i]]], 1)
        out.append((np.clip(x, off[i], off[i + 1]) - off[i]).reshape(-1).tolist())
    return out


def per_document(docs: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """The classes' columns for every row of docs; copies of ``length`` bytes lose all."""
    copy = (F.col("n_bytes") >= length) & F.col("m").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("m")))
    own = [c for c in found.columns if c not in ("k", "m", "n_bytes", "n_removed", "n_spans")]
    empty = {"spans": F.array(F.lit(0).cast("long"), F.col("n_bytes")), "kept": F.lit(b""), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return keyed(docs).select("doc_id", "k").join(found, "k").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        *(F.when(copy, empty[c]).otherwise(F.col(c)).alias(c) for c in own))


def _figures(found: DataFrame) -> DataFrame:
    return found.withColumn("n_spans", F.expr("cast(size(spans) div 2 as long)")).withColumn("n_removed", F.col("n_bytes") - F.length("kept"))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept (the remaining bytes) per row."""
    stage = Stage(docs.sparkSession, "bytes")
    texts = stage.table("texts", distinct_texts(docs))
    return per_document(docs, _figures(classes(texts, stage, length)), length)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: `dedup` with the bytes as digests before they are dealt out to copies."""
    stage = Stage(docs.sparkSession, "bytes")
    texts = stage.table("texts", distinct_texts(docs))
    found = _figures(classes(texts, stage)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("spans", "kept")
    return per_document(docs, found)
