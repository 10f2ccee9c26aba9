"""Language-model scoring by deleted interpolation (operator 10).

A bigram model is counted over all training documents. A token's probability mixes the
bigram's and the word's relative frequency and a uniform share; the weights depend on how
often the context was seen (one bucket per power of two) and are learned by
expectation-maximisation on counts from which the token's own document has been deleted.

Counts are gathered and looked up by `_tally`: every pass works on bounded blocks of
documents, and no count leaves the executors except the histogram that EM reads, whose size
is bounded by the number of bins.

Cases: null text is empty (its score is that of the end token); a null doc_id is scored and
trains like any other; repeated rows each count and each return a row; a very long text is
read whole (a block holds whole documents); extra columns are ignored; an empty table returns
no rows. Without training tokens every probability is uniform over one type.
"""

from __future__ import annotations


import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _tally as Q
from plumbline.llm import _text as T
from plumbline.llm._stage import Stage, blocks, buckets

END = T.mix(np.array([1], T.U))[0]
WORD, PAIR = 1, 2
#: Bins per doubling and range of the histogram that EM reads, of an estimate over the uniform one.
PER_DOUBLING, BINS = 4, 256
ADD = 0.1


def _tokens(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with each row's end, the hash of each token and its predecessor, row offsets."""
    h, w = T.word_hashes(*T.bytes_of(t["text"]), lower=True)
    n = len(w) - 1
    off = w + np.arange(n + 1)
    tok = np.full(off[-1], END, T.U)
    tok[T.ranges(off[:-1], np.diff(w))] = h
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[off[:-1]] = END
    return tok, T.mix(tok * T.U(0x9FB21C651E98DF25) + before), off


def _count(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    uniq, inv = np.unique(keys, return_inverse=True)
    return uniq, inv, np.bincount(inv, train, minlength=len(uniq)).astype(np.int64)


def _total(kind: int, group: np.ndarray, vals: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    c = Q.sums(group, vals[0])
    return [c[group]], [int(c.sum()), int((c > 0).sum())] if kind == WORD else []


def _bin(x: np.ndarray) -> np.ndarray:
    """0 for an estimate of 0, else its doubling relative to the uniform estimate, in bins."""
    with np.errstate(divide="ignore"):
        b = np.round(np.log2(x) * PER_DOUBLING) + BINS // 3
    return np.where(x > 0, np.clip(b, 1, BINS - 1), 0).astype(np.int64)


def _value(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** ((b - BINS // 3) / PER_DOUBLING), 0.0)


HISTOGRAM = "slot int, bucket int, codes binary, counts binary"


def _histogram(slot: int, counts: dict[int, np.ndarray]) -> pa.Table:
    """A row for each context bucket: the bins (of both estimates) that occur, and how often."""
    held = {b: np.flatnonzero(c) for b, c in counts.items()}
    return pa.table({
        "slot": pa.array([slot] * len(held), pa.int32()), "bucket": pa.array(list(held), pa.int32()),
        "codes": pa.array([Q.pack(Q.small(at)) for at in held.values()], pa.binary()), "counts": pa.array([Q.pack(Q.small(counts[b][at])) for b, at in held.items()], pa.binary())})


def _merged(key: tuple, t: pa.Table) -> pa.Table:
    """Histograms of one context bucket added up, one after another."""
    total = np.zeros(BINS**2, np.int64)
    for codes, counts in zip(t["codes"], t["counts"], strict=True):
        total[Q.unpack(codes.as_py())] += Q.unpack(counts.as_py())
    return _histogram(0, {key[-1].as_py(): total})


def fit_weights(rows: np.ndarray | list[tuple[int, int, int, float]], steps: int = 50) -> dict[int, tuple[float, float, float]]:
    """Mixture weights (bigram, word, uniform) by context bucket from (bucket, bins, bins, count)."""
    out = {}
    data = np.array(rows, float).reshape(-1, 4)
    for b in np.unique(data[:, 0]):
        part = data[data[:, 0] == b]
        p = np.stack([_value(part[:, 1]), _value(part[:, 2]), np.ones(len(part))])
        w, n = np.full(3, 1 / 3), part[:, 3]
        for _ in range(steps):
            share = w[:, None] * p
            share /= share.sum(0)
            w = (share * n).sum(1) / n.sum()
        w = np.maximum(w, 1e-6)
        out[int(b)] = tuple(w / w.sum())
    return out


def _bucket(c: np.ndarray) -> np.ndarray:
    """The context's bucket: 0 if unseen, else one for each doubling."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)


def score(docs: DataFrame, train: str = "train", stage: Stage | None = None) -> DataFrame:
    """doc_id, train, text scored: n_tokens, n_known, train_tokens, base_score, score (log10).

    ``docs`` has doc_id, text and the boolean column ``train``; rows where it is true are learned from.
    """
    spark = docs.sparkSession
    stage = stage or Stage(spark, "lm")
    n = buckets(spark)
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks(spark))).cast("int").alias("block"), "doc_id",
        F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        tok, pair, off = _tokens(t)
        learn = np.repeat(np.array(t["train"].to_pylist(), bool), np.diff(off)).astype(float)
        out = []
        for kind, keys in ((WORD, tok), (PAIR, pair)):
            uniq, _, c = _count(keys, learn)
            out += Q.asks(key[0].as_py(), kind, uniq, [c], n)
        return Q.table_of(out)

    told = stage.table("counts", Q.answers(rows.groupBy("block").applyInArrow(ask, Q.ASK), _total))
    whole = [(r.vals[0], r.vals[1]) for r in told.filter("block = -1").select("vals").collect()]  # one row a bucket
    total, types = (sum(int(Q.unpack(bytes(x[i]))[0]) for x in whole) for i in (0, 1))
    told = told.filter("block >= 0")

    def looked_up(t: pa.Table, r: pa.Table) -> tuple:
        tok, pair, off = _tokens(t)
        out = []
        for kind, keys in ((WORD, tok), (PAIR, pair)):
            _, inv = np.unique(keys, return_inverse=True)
            out.append(Q.replies(r, kind)[inv])
        return (*out, tok, pair, off)

    flat = 1 / (types + 1)

    def histogram(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        word, both, tok, pair, off = looked_up(t, r)
        doc = T.owners(off)
        learn = np.array(t["train"].to_pylist(), bool)[doc]
        own = []
        for keys in (tok, pair):
            _, inv, c = np.unique(T.mix(keys) + doc.astype(T.U) * T.U(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
            own.append(c[inv])
        context, mine = np.empty_like(word), np.empty_like(word)
        context[1:], mine[1:] = word[:-1], own[0][:-1]
        ends = off[1:] - 1
        context[off[:-1]], mine[off[:-1]] = word[ends], own[0][ends]
        left = context - mine
        with np.errstate(divide="ignore", invalid="ignore"):
            two = np.where(left > 0, (both - own[1]) / np.maximum(left, 1), 0.0)
        one = (word - own[0]) / max(1, total)
        code, held = (_bin(np.maximum(two, 0) / flat) * BINS + _bin(np.maximum(one, 0) / flat))[learn], _bucket(np.maximum(left, 0))[learn]
        return _histogram(key[0].as_py(), {int(b): np.bincount(code[held == b], minlength=BINS**2) for b in np.unique(held)})

    grouped = rows.groupBy("block").cogroup(told.groupBy("block"))
    # blocks' histograms are merged in as many piles as each has members; then one row a context bucket (at most 65) reaches the driver
    pile = F.pmod("slot", F.lit(math.isqrt(blocks(spark)) + 1)).alias("pile")
    hist = grouped.applyInArrow(histogram, HISTOGRAM).groupBy(pile, "bucket").applyInArrow(_merged, HISTOGRAM).groupBy("bucket").applyInArrow(_merged, HISTOGRAM).collect()
    bins = [(r.bucket, Q.unpack(bytes(r.codes)), Q.unpack(bytes(r.counts))) for r in hist]
    weights = fit_weights(np.concatenate([np.zeros((0, 4)), *(np.stack([np.full(len(c), b), c // BINS, c % BINS, x], 1) for b, c, x in bins)]))
    table = np.array([weights.get(b, (0.0, 0.5, 0.5)) for b in range(66)])

    def scored(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        word, both, _, _, off = looked_up(t, r)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[off[:-1]] = word[off[1:] - 1]
        w = table[_bucket(context)]
        p = w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * word / max(1, total) + w[:, 2] * flat
        base = np.log10((word + ADD) / (total + ADD * (types + 1)))
        add = np.add.reduceat
        at = off[:-1]
        return pa.table({
            "doc_id": t["doc_id"], "train": t["train"], "n_tokens": np.diff(off), "n_known": add((word > 0).astype(np.int64), at),
            "train_tokens": np.full(len(at), total), "base_score": add(base, at), "score": add(np.log10(p), at)})

    return grouped.applyInArrow(scored, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """Per token perplexity of held-out and training documents, by the base and by the model."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("train").agg(per("base_score").alias("base"), per("score").alias("model"))


