"""Removal of repeated passages by recompression (operator 3).

Every text's words are named by hashes, and rounds of recompression replace runs of one
symbol and then pairs whose left symbol is of one class and right symbol of the other (the
classes come from a round's hash bit) by new names. A name depends on the words it stands
for alone, so equal passages get equal interior symbols in whichever document or task they
stand. With each symbol goes its context: the words that fix it. A passage of ``window``
words that holds the context of a symbol can only repeat in another document if the symbol
does.

One Spark pass asks which high-level symbols occur in more than one text; it leaves alive
only the windows all of whose symbols do (and those, in long runs, that hold no symbol's
context). A second pass verifies the live windows by the hash of their words, and finds the
smallest doc_id each starts in. A word goes if a window that covers it also starts in a
document with a smaller doc_id.

Cases: null text has no words; copies of a text are folded into the smallest doc_id, whose
copies lose everything if they have ``window`` words; rows with one doc_id are one document
and don't remove each other's words; a null doc_id counts as the largest; a very long text is
read whole, slice by slice of its words; extra columns are ignored, but for `replaced`, which
carries them through unchanged, whatever their names; an empty table returns no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _tally as Q
from plumbline.llm import _text as T
from plumbline.llm._stage import Stage, buckets, distinct_texts, fresh, keyed

WINDOW, ROUNDS = 50, 5
SYMBOL, PASSAGE, ALIVE = 1, 2, 3
FAR = 1 << 40
LAST = np.iinfo(np.int64).max


def recompress(h: np.ndarray, off: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds: name, row, and the first and past-the-last word of the context."""
    sym, row = h.copy(), T.owners(off)
    s = np.arange(len(h))
    e, cs, ce = s + 1, s.copy(), s + 1
    for r in range(rounds):
        # runs: a boundary stays where the neighbours differ, which a word beside it mostly shows
        m = len(sym)
        if not m:
            break
        apart = np.ones(m + 1, bool)
        apart[1:m] = row[1:] != row[:-1]
        first = apart[:m].copy()
        first[1:] |= sym[1:] != sym[:-1]
        i = np.flatnonzero(first)
        j = np.append(i[1:], m) - 1
        left = np.where(h[s[i] - 1] != h[e[i] - 1], s[i] - 1, cs[i - 1])
        nxt = np.minimum(j + 1, m - 1)
        right = np.where(h[s[nxt]] != h[s[j]], e[j] + 1, ce[nxt])
        cs2 = np.where(apart[i], -FAR, np.minimum(cs[i], left))
        ce2 = np.where(apart[j + 1], FAR, np.maximum(ce[j], right))
        run = j - i + 1
        sym = np.where(run > 1, T.mix(sym[i] * T.U(0xA0761D6478BD642F) + run.astype(T.U)), sym[i])
        s, e, cs, ce, row = s[i], e[j], cs2, ce2, row[i]
        # pairs: the left class starts a symbol whatever precedes it, the right class ends one
        m = len(sym)
        right_class = (T.mix(sym + T.U(r + 1)) >> T.U(63)).astype(bool)
        apart = np.ones(m + 1, bool)
        apart[1:m] = row[1:] != row[:-1]
        first = np.ones(m, bool)
        first[1:] = apart[1:m] | ~right_class[1:] | right_class[:-1]
        i = np.flatnonzero(first)
        j = np.append(i[1:], m) - 1
        single = i == j
        cs2 = np.where(single & right_class[i], np.where(apart[i], -FAR, np.minimum(cs[i], cs[i - 1])), np.minimum(cs[i], cs[j]))
        ce2 = np.where(single & ~right_class[i], np.where(apart[i + 1], FAR, np.maximum(ce[i], ce[np.minimum(i + 1, m - 1)])), np.maximum(ce[i], ce[j]))
        sym = np.where(single, sym[i], T.mix(sym[i] * T.U(0xE7037ED1A0B428DB) + sym[j]))
        s, e, cs, ce, row = s[i], e[j], cs2, ce2, row[i]
    return sym, row, cs, ce


def _window_starts(off: np.ndarray, window: int) -> np.ndarray:
    """True where a whole window of the row starts."""
    out = np.zeros(off[-1] + 1, np.int64)
    n = np.maximum(np.diff(off) - window + 1, 0)
    np.add.at(out, off[:-1], n > 0)
    np.add.at(out, off[:-1] + n, -(n > 0).astype(np.int64))
    return np.cumsum(out[:-1]) > 0


def _order(t: pa.Table) -> np.ndarray:
    return T.column(t, "m").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _rejoined(buf: np.ndarray, off: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """Each row's kept words joined by one space."""
    out, base = [], 0
    for lo, hi in T.slices(off):
        part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        s, e, w = T.words(part, o)
        kept = keep[base : base + len(s)]
        base += len(s)
        n = np.concatenate(([0], np.cumsum(kept)))[w]
        s, e = s[kept], e[kept]
        size = e - s + 1
        data = part[np.minimum(T.ranges(s, size), len(part) - 1)] if len(s) else part[:0]
        ends = np.cumsum(size)
        data[ends - 1] = 32
        at = np.concatenate(([0], ends))[n]
        raw = data.tobytes()
        out += [raw[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def classes(texts: DataFrame, stage: Stage, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Per distinct text: k, m, n_words, n_removed and kept, for its smallest doc_id m."""
    n = buckets(texts.sparkSession)

    def symbols(t: pa.Table) -> tuple:
        T.release()
        h, off = T.word_hashes(*T.bytes_of(t["text"]), lower=False)
        got = [(np.zeros(0, T.U), *(np.zeros(0, np.int64) for _ in range(3)))]
        for lo, hi in T.slices(off, T.WORDS):
            sym, row, cs, ce = recompress(h[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], rounds)
            use = ce - cs <= window
            got.append((sym[use] & T.COARSE, row[use] + lo, cs[use] + off[lo], ce[use] + off[lo]))
        return h, off, *map(np.concatenate, zip(*got, strict=True))

    def ask_symbols(key: tuple, t: pa.Table) -> pa.Table:
        _, _, sym, row, _, _ = symbols(t)
        order = np.argsort(sym, kind="stable")  # rows ascend already
        sym, row = sym[order], row[order]
        new = np.ones(len(sym), bool)
        new[1:] = sym[1:] != sym[:-1]
        many = np.zeros(len(sym), bool)
        many[1:] = ~new[1:] & (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        held = 1 + np.logical_or.reduceat(many, at).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        return Q.table_of(list(Q.asks(key[0].as_py(), SYMBOL, sym[at], [held], n)))

    def named(t: pa.Table, h: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 bits of the windows' first hash and 32 bits of a second one, which rests on other hashes of the words."""
        if not len(at):
            return np.zeros(0, T.U), at
        other, _ = T.word_hashes(*T.bytes_of(t["text"]), lower=False, which=1)
        return T.row_windows(h, off, at, window), (T.row_windows(other, off, at, window, 1) >> T.U(32)).astype(np.int64)

    def in_several(kind: int, group: np.ndarray, vals: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        return [(Q.sums(group, vals[0]) > 1)[group].astype(np.int64)], []

    def ask_windows(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        t = t.sort_by("k")  # places of windows are kept for the last pass, where rows may come in another order
        h, off, sym, row, cs, ce = symbols(t)
        _, inv = T.groups(sym)
        alone = Q.replies(r, SYMBOL)[inv] == 0
        dead = np.zeros(len(h) + 1, np.int64)
        lo, hi = np.maximum(ce[alone] - window, off[row[alone]]), cs[alone] + 1
        np.add.at(dead, lo, 1)
        np.add.at(dead, hi, -1)
        alive = _window_starts(off, window) & (np.cumsum(dead[:-1]) == 0)
        at = np.flatnonzero(alive)
        keys, check = named(t, h, off, at)
        order, first, _ = Q.pairs(keys, check)
        smallest = np.minimum.reduceat(_order(t)[T.owners(off)[at]][order], first) if len(at) else at
        lead, block = order[first], key[0].as_py()
        out = list(Q.asks(block, PASSAGE, keys[lead], [smallest, check[lead]], n))
        out.append({"block": block, "bucket": -1, "kind": ALIVE, "n": len(h), "keys": None, "vals": [Q.pack(np.packbits(alive))]})
        return Q.table_of(out)

    def earliest(kind: int, group: np.ndarray, vals: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        group = Q.finer(group, vals[1])
        return [Q.minima(group, vals[0])[group]], []

    def remove(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        T.release()
        t = t.sort_by("k")
        buf, byte_off = T.bytes_of(t["text"])
        h, off = T.word_hashes(buf, byte_off, lower=False)
        alive = np.unpackbits(Q.replies(r, ALIVE).astype(np.uint8), count=len(h)).astype(bool) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(alive)
        _, _, inv = Q.pairs(*named(t, h, off, at))
        row = T.owners(off)
        again = at[Q.replies(r, PASSAGE)[inv] < _order(t)[row[at]]] if len(at) else at
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + window, -1)
        keep = np.cumsum(cover[:-1]) == 0
        kept = np.concatenate(([0], np.cumsum(keep)))
        n_words = np.diff(off)
        return pa.table({"k": t["k"], "m": t["m"], "n_words": n_words, "n_removed": n_words - (kept[off[1:]] - kept[off[:-1]]), "kept": pa.array(_rejoined(buf, byte_off, keep), pa.binary()).cast(pa.string())})

    blocks = texts.groupBy("block")
    shared = stage.table("symbols", Q.answers(blocks.applyInArrow(ask_symbols, Q.ASK), in_several))
    asked = stage.table("windows", blocks.cogroup(shared.groupBy("block")).applyInArrow(ask_windows, Q.ASK))
    stage.drop("symbols")
    first = stage.table("passages", Q.answers(asked.filter("bucket >= 0"), earliest).unionByName(asked.filter("bucket < 0")))
    stage.drop("windows")
    return blocks.cogroup(first.groupBy("block")).applyInArrow(remove, "k binary, m long, n_words long, n_removed long, kept string")


def per_document(docs: DataFrame, found: DataFrame, value: str, emptied: F.Column, window: int = WINDOW) -> DataFrame:
    """The classes' figures and ``value`` for every row of docs; copies of ``window`` words lose all."""
    copy = (F.col("n_words") >= window) & F.col("m").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("m")))
    return keyed(docs).select("doc_id", "k").join(found, "k").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, emptied).otherwise(F.col(value)).alias(value))


def dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) per row."""
    stage = Stage(docs.sparkSession, "substring")
    texts = stage.table("texts", distinct_texts(docs))
    return per_document(docs, classes(texts, stage, window, rounds), "kept", F.lit(""), window)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: `dedup` with the texts as digests before they are dealt out to copies."""
    stage = Stage(docs.sparkSession, "substring")
    texts = stage.table("texts", distinct_texts(docs))
    found = classes(texts, stage).select("k", "m", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return per_document(docs, found, "kept_sha256", F.sha2(F.lit(""), 256))


def replaced(docs: DataFrame, column: str, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """docs with the texts of ``column`` after removal; texts that lose nothing stay as they are, those that lose all go."""
    stage = Stage(docs.sparkSession, "substring")
    own = docs.select("doc_id", F.col(column).alias("text"))
    texts = stage.table("texts", distinct_texts(own))
    # a text has lost words only if it is in here; copies of a text are told by the join
    found = classes(texts, stage, window, rounds).filter((F.col("n_removed") > 0) | (F.col("n_words") >= window))
    mine = fresh("found", docs.columns)  # one column beside those of docs, whatever they are called
    found = stage.table("found", found.select(F.struct("k", "m", "n_words", "n_removed", F.when(F.col("n_removed") > 0, F.col("kept")).alias("kept")).alias(mine)))
    of = lambda c: F.col(f"{mine}.{c}")
    both = docs.join(found, F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")))) == of("k"), "left")
    copy = (of("n_words") >= window) & of("m").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > of("m")))
    left = both.filter(~F.coalesce(copy | (of("n_removed") == of("n_words")), F.lit(False)))
    text = F.when(F.coalesce(of("n_removed") > 0, F.lit(False)), of("kept")).otherwise(F.col(column))
    return left.withColumn(column, text).select(*(F.col(f"`{c}`") for c in docs.columns))
