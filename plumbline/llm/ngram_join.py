"""Join of texts on the Jaccard similarity of their word n-grams (operator 2).

Every text is a set of hashed shingles, and a point: the counts of its shingles by group (the
leading bits of the hash). Two sets share at most the sum of their points' coordinate minima.

1. A corpus-wide tally of shingles (48 bits of the hash: a chance collision only raises a
   count) tells how many texts hold each. A text links only if enough of its shingles are
   held by others. Its keys are then the rarest of its shingles, as many as a partner cannot
   miss; two texts that link share a key.
2. At the root, every key routes its texts to its smallest doc_id. Pairs that pass the bound
   are verified on their whole sets, and connected components are formed.
3. Texts that share a root, but not a component, are searched by count-vector R-trees: they
   are dealt to cells, each cell packs its points into a tree whose nodes know their greatest
   coordinates and least size, and texts descend where the bound allows a link. Surviving
   pairs of different components are verified, and components formed again.

Pairs in one component need no comparison, so a group of copies costs a pass over its members
and not over its pairs; no pair that could join two components is left out.

Cases: null and empty text have no shingles and link with nothing; copies of a text are one
point; rows with one doc_id are one document and pool their links (n_shingles is each row's
own, and a row without shingles stays by itself); rows with a null doc_id take no part and have
a null component_id; a very long text is one set of all its shingles; extra columns are
ignored; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _tally as Q
from plumbline.llm import _text as T
from plumbline.llm._graph import components
from plumbline.llm._stage import Stage, buckets, distinct_texts, keyed

SHINGLE = 1
GROUPS, FANOUT, CELL = 64, 16, 256


def shingles(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles in ascending order, and the rows' offsets."""
    T.release()
    h, off = T.word_hashes(*T.bytes_of(t["text"]), lower=True)
    got = [_sets(h[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size) for lo, hi in T.slices(off, T.WORDS)]
    counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in got)])
    return np.concatenate([np.zeros(0, T.U), *(k for k, _ in got)]), np.concatenate(([0], np.cumsum(counts)))


def _sets(h: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' shingles one after another, and each row's number, from word hashes."""
    n = np.diff(off)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    start = T.ranges(off[:-1], count)
    row = np.repeat(np.arange(len(n)), count)
    key = T.runs(h, start, np.minimum(n, size)[row])
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], np.bincount(row[new], minlength=len(n))


def point(sh: np.ndarray) -> np.ndarray:
    return np.bincount((sh >> T.U(58)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of these sizes link."""
    return -(-(percent * (a + b)) // (100 + percent))


class Tree:
    """Packed R-tree over count vectors: every node of FANOUT points or nodes knows its coordinate maxima and least size, up to one root."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> None:
        # packed by size, then by the group that stands out most, so that a node's maxima stay low
        self.order = np.lexsort((points.argmax(1), sizes * 8 // np.maximum(sizes.max(), 1))) if len(sizes) else np.zeros(0, np.int64)
        self.percent = percent
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > 1:
            top, least = self.levels[-1]
            edges = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(top, edges, axis=0), np.minimum.reduceat(least, edges)))

    def search(self, point_: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points that may link with this one: only nodes whose bound allows a link are opened."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            at = at[np.minimum(top[at], point_).sum(1) >= needed(least[at], size, self.percent)]
            if depth:
                at = T.ranges(at * FANOUT, np.minimum((at + 1) * FANOUT, len(self.levels[depth - 1][1])) - at * FANOUT)
        return self.order[at]


def sets(texts: DataFrame, stage: Stage, size: int, percent: int) -> DataFrame:
    """Per distinct text k, m, s (its shingles' number); where it may link also sh, pt and keys."""
    n = buckets(texts.sparkSession)

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        uniq, c = np.unique(shingles(t, size)[0] & T.COARSE, return_counts=True)
        return Q.table_of(list(Q.asks(key[0].as_py(), SHINGLE, uniq, [c], n)))

    def held(kind: int, group: np.ndarray, vals: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        return [Q.sums(group, vals[0])[group]], []

    def make(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        sh, off = shingles(t, size)
        _, inv = T.groups(sh & T.COARSE)
        df = Q.replies(r, SHINGLE)[inv]
        s = np.diff(off)
        least = -(-percent * s // 100)
        shared = np.concatenate(([0], np.cumsum(df > 1)))
        may = (s > 0) & (shared[off[1:]] - shared[off[:-1]] >= least)
        out = {"sh": [None] * len(s), "pt": [None] * len(s), "keys": [None] * len(s)}
        for i in np.flatnonzero(may).tolist():
            own, d = sh[off[i] : off[i + 1]], df[off[i] : off[i + 1]]
            first = np.lexsort((own, d))[: int(s[i] - least[i] + 1)]
            out["sh"][i], out["pt"][i] = own.tobytes(), point(own).tobytes()
            out["keys"][i] = own[first[d[first] > 1]].view(np.int64).tolist()
        return pa.table({"k": t["k"], "m": t["m"], "s": s, "sh": pa.array(out["sh"], pa.binary()), "pt": pa.array(out["pt"], pa.binary()), "keys": pa.array(out["keys"], pa.list_(pa.int64()))})

    blocks = texts.groupBy("block")
    told = stage.table("held", Q.answers(blocks.applyInArrow(ask, Q.ASK), held))
    return stage.table("sets", blocks.cogroup(told.groupBy("block")).applyInArrow(make, "k binary, m long, s long, sh binary, pt binary, keys array<long>"))


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    side = lambda x: found.select(F.col("m").alias(x), F.col("s").alias(f"s{x}"), F.col("pt").alias(f"p{x}"), F.col("sh").alias(f"h{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            cols = [x.column(c).to_pylist() for c in ("pa", "pb", "ha", "hb")]
            ok = []
            for p, q, a, b in zip(*cols, strict=True):
                least = int(needed(np.int64(len(a) // 8), np.int64(len(b) // 8), percent))
                ok.append(
                    int(np.minimum(np.frombuffer(p, np.int32), np.frombuffer(q, np.int32)).sum()) >= least
                    and len(np.intersect1d(np.frombuffer(a, T.U), np.frombuffer(b, T.U), assume_unique=True)) >= least)
            yield pa.RecordBatch.from_pydict({c: x.column(c) for c in ("a", "b")}).filter(pa.array(ok, pa.bool_()))

    ready = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(sa, sb) >= {percent} * greatest(sa, sb)")
    return ready.select("a", "b", "pa", "pb", "ha", "hb").mapInArrow(check, "a long, b long")


def pooled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: documents (doc_id) that have several texts, each with the smallest document of the text."""
    several = rows.groupBy("doc_id").agg(F.min("k").alias("k0"), F.max("k").alias("k1")).filter("doc_id is not null and k0 != k1").select("doc_id")
    named = rows.join(several, "doc_id").join(found.filter("s > 0 and m is not null").select("k", "m"), "k")
    return named.filter("doc_id != m").select(F.col("doc_id").alias("a"), F.col("m").alias("b")).distinct()


def links(found: DataFrame, pool: DataFrame, stage: Stage, percent: int) -> DataFrame:
    """node, comp: the texts that link with others, by their documents' smallest ids; ``pool`` holds links (a, b) known beforehand."""
    texts = found.filter("keys is not null and m is not null")
    member = stage.table("members", texts.select("m", "s", F.explode("keys").alias("key")))
    group = member.groupBy("key").agg(F.min("m").alias("rep"), F.count("*").alias("size")).filter("size > 1").select("key", "rep")
    pairs = stage.table("pairs", member.join(group, "key").filter("m != rep").select(F.col("m").alias("a"), F.col("rep").alias("b")).distinct())
    stage.drop("members")
    root = stage.table("links-root", verified(pairs, texts, percent).unionByName(pool))
    comp = components(root, stage, "root")

    label = lambda x, c: comp.select(F.col("node").alias(x), F.col("comp").alias(c))
    named = pairs.join(label("a", "ca"), "a", "left").join(label("b", "cb"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("comp"), F.coalesce("cb", "b").alias("main"))
    inside = F.col("comp") == F.col("main")
    fill = lambda x: F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.when(x, 1)) / CELL))
    open_ = named.groupBy("b").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), fill(inside).alias("cells"), fill(~inside).alias("blocks")).filter("c0 != c1").select("b", "cells", "blocks")
    # the root's component holds most of a group of copies: its texts are dealt to cells, others to blocks; each block meets
    # each cell (kind 0), and each two blocks meet once (kind 1)
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    at = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    slot = lambda n: F.pmod(F.xxhash64("a", "b"), F.col(n))
    own = slot("blocks")
    others = F.transform(F.filter(to("blocks"), lambda y: y != own), lambda y: at(1, F.least(own, y), F.greatest(own, y)))
    visits = F.when(inside, F.transform(to("blocks"), lambda y: at(0, slot("cells"), y))).otherwise(F.concat(F.transform(to("cells"), lambda x: at(0, x, own)), others))
    cell = named.join(open_, "b").select("b", F.explode(visits).alias("cell"), F.col("a").alias("m"), "comp", "main")
    cell = cell.join(texts.select("m", "s", "sh"), "m").select("b", "cell.kind", "cell.x", "cell.y", "m", "comp", "main", "s", "sh")

    def search(key: tuple, t: pa.Table) -> pa.Table:
        """Verified links between components, one for each two that meet here."""
        t = t.sort_by("m")
        m, comp_, main, s = (t[c].to_numpy() for c in ("m", "comp", "main", "s"))
        own = [np.frombuffer(x, T.U) for x in t["sh"].to_pylist()]
        tree = Tree(np.stack([point(x) for x in own]), s, percent)
        root = {c: c for c in np.unique(comp_).tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        a, b = [], []
        for i in np.flatnonzero(comp_ != main).tolist():
            for j in tree.search(point(own[i]), int(s[i])).tolist():
                x, y = top(int(comp_[i])), top(int(comp_[j]))
                if x != y and len(np.intersect1d(own[i], own[j], assume_unique=True)) >= needed(s[i], s[j], percent):
                    root[max(x, y)] = min(x, y)
                    a.append(int(m[i]))
                    b.append(int(m[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    extra = stage.table("links-tree", cell.groupBy("b", "kind", "x", "y").applyInArrow(search, "a long, b long").distinct())
    if not extra.limit(1).count():
        return comp
    return components(root.unionByName(extra), stage, "all")


def join(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) per row."""
    spark = docs.sparkSession
    stage = Stage(spark, "ngrams")
    found = sets(stage.table("texts", distinct_texts(docs)), stage, size, percent)
    stage.drop("texts")
    rows = stage.table("rows", keyed(docs).select("doc_id", "k"))
    comp = links(found, pooled(rows, found), stage, percent)
    named = found.select("k", "m", "s").join(comp, F.col("m") == F.col("node"), "left").select("k", "s", F.coalesce("comp", "m").alias("comp"))
    return rows.join(named, "k").select(
        "doc_id", F.col("s").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("s") > 0, F.col("comp")).otherwise(F.col("doc_id"))).alias("component_id"))
