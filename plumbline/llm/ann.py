"""Approximate nearest neighbours by a forest of random-projection trees (operator 1).

Each tree halves a bounded sample of the rows again and again: it projects them on the
difference of two random sample points and splits at the median. The forest (at most
``trees`` x ``leaves`` hyperplanes) is broadcast; every row is then dealt to one leaf of every
tree. A query walks all trees at once through one priority queue, nearest splits first, until
``probes`` leaves are chosen. A leaf's queries are dealt to blocks of bounded size, its rows to
cells; a task holds one block and its k nearest so far, and the rows of a cell pass by it in
batches, so that memory depends on neither. Inner products of what may be among the nearest are
taken exactly, in double precision. A last step keeps the nearest of all leaves and cells.

Cells follow the work: all blocks and cells together number some four a partition, so that a
leaf with very many rows (copies of one vector) is spread, and the last step reads at most k
rows of each cell a query visits, however many rows there are.

Vectors without clusters (independent random directions) have no near neighbours that a split
could keep together: there the share of leaves to visit for a recall of 0.9 is large at any
size, and the production parameters are set for such tables.

Cases: vectors that are null, zero, of another length than the table's (the most frequent in
the sample) or that hold null or non-finite components take no part; a null vec_id takes no
part; rows of one vec_id and vector are one candidate (vec_id is
taken to be unique: of several vectors under one id any one may be kept); extra columns are ignored; ties go to the smaller vec_id; an empty
table returns no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._stage import Stage, parts

#: Production parameters: sample rows that fit the forest, trees, leaves a tree, leaves a query visits.
SAMPLE, TREES, LEAVES, PROBES, CELL = 8192, 3, 32, 44, 1024
#: Queries of one block; (block, cell) groups a partition.
ASKED, GROUPS = 8192, 4


class Forest:
    """Hyperplanes of complete binary trees, level by level: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, trees: int, leaves: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.log2(max(1, min(leaves, len(sample) // 4)))))
        nodes, dim = (1 << self.depth) - 1, sample.shape[1]
        self.normal, self.offset = np.zeros((trees, nodes, dim)), np.zeros((trees, nodes))
        for t in range(trees):
            held = [np.arange(len(sample))]
            for i in range(nodes):
                rows = held[i]
                v = np.zeros(dim)
                if len(rows) > 1:
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    v = a - b
                if not v.any():
                    v = rng.standard_normal(dim)
                v /= np.sqrt((v * v).sum())
                side = sample[rows] @ v
                mid = float(np.median(side)) if len(rows) else 0.0
                self.normal[t, i], self.offset[t, i] = v, mid
                held += [rows[side < mid], rows[side >= mid]]

    def margins(self, x: np.ndarray, tree: int) -> np.ndarray:
        return x @ self.normal[tree].T - self.offset[tree]

    def leaf(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Each row's leaf in one tree."""
        side = self.margins(x, tree) >= 0
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + side[np.arange(len(x)), at]
        return at - ((1 << self.depth) - 1)

    def probe(self, x: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
        """For each query the (tree, leaf) pairs that come first in the queue that all trees share."""
        trees, inner = len(self.normal), (1 << self.depth) - 1
        margin = np.stack([self.margins(x, t) for t in range(trees)], 1)
        out = []
        for m in margin:
            queue: list[tuple[float, int, int]] = [(0.0, t, 0) for t in range(trees)]
            found: list[tuple[int, int]] = []
            while queue and len(found) < probes:
                far, t, i = heapq.heappop(queue)
                while i < inner:
                    d = m[t, i]
                    near, other = (2 * i + 2, 2 * i + 1) if d >= 0 else (2 * i + 1, 2 * i + 2)
                    heapq.heappush(queue, (max(far, abs(d)), t, other))
                    i = near
                found.append((t, i - inner))
            out.append(found)
        return out


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vec (array of double) of the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & fine)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array(col.flatten()).reshape(len(col), -1)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, each summed in component order."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += a[:, i, None] * b[None, :, i]
    return out


class Block:
    """A block of queries and the k nearest of the rows that have passed by."""

    def __init__(self, k: int, dim: int) -> None:
        self.k, self.dim = k, dim
        self.asked: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids = self.x = self.found = self.score = None

    def ask(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.asked.append((ids, x))

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        if self.ids is None:
            self.ids, self.x = (np.concatenate(c) for c in zip(*self.asked, strict=True))
            self.found, self.score = np.full((len(self.ids), self.k), np.iinfo(np.int64).max), np.full((len(self.ids), self.k), -np.inf)
        k = self.k
        for lo in range(0, len(self.ids), 256):
            part, own = self.x[lo : lo + 256], self.ids[lo : lo + 256]
            rough = part @ x.T
            rough[own[:, None] == ids[None, :]] = -np.inf
            # what may be among the k nearest, by a product whose last bits depend on the block; then exactly
            edge = self.score[lo : lo + 256, -1]
            if rough.shape[1] > k and not np.isfinite(edge).all():
                edge = np.maximum(edge, np.partition(rough, -k, axis=1)[:, -k])
            edge = np.where(np.isfinite(edge), edge - 1e-9 * (1 + np.abs(edge)), -1e300)
            i, j = np.nonzero(rough >= edge[:, None])
            if not len(i):
                continue
            score = np.zeros(len(i))
            for d in range(self.dim):
                score += part[i, d] * x[j, d]
            held = np.unique(i)
            i, v, score = np.concatenate([np.repeat(held, k), i]), np.concatenate([self.found[lo + held].reshape(-1), ids[j]]), np.concatenate([self.score[lo + held].reshape(-1), score])
            best = np.lexsort((v, -score, i))
            i, v, score = i[best], v[best], score[best]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < k
            self.found[lo + i[keep], place[keep]], self.score[lo + i[keep], place[keep]] = v[keep], score[keep]

    def nearest(self) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            i, j = np.nonzero(self.score > -np.inf)
            yield pa.RecordBatch.from_pydict({"query_id": self.ids[i], "vec_id": self.found[i, j], "score": self.score[i, j]})


def _runs(b: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """Values, start and end of each run of equal values in these columns."""
    key = np.stack([b.column(c).to_numpy() for c in names], 1)
    cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if hi > lo:
            yield tuple(key[lo].tolist()), lo, hi


def search(rows: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, leaves: int = LEAVES, probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, itself left out.

    ``rows`` and ``queries`` have vec_id and embedding.
    """
    spark = rows.sparkSession
    stage = Stage(spark, "ann")
    base, asked = usable(rows), usable(queries)
    # the rows whose hashes are least: a bounded sample, whatever the input
    seen = [list(r.vec) for r in base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").collect()]
    schema = "query_id long, rank int, vec_id long, score double"
    if not seen:
        return spark.createDataFrame([], schema)
    sizes, counts = np.unique([len(v) for v in seen], return_counts=True)
    dim = int(sizes[counts.argmax()])
    forest = Forest(np.array([v for v in seen if len(v) == dim]), trees, leaves)
    shared = spark.sparkContext.broadcast(forest)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = _matrix(b.column("vec")).reshape(len(b), dim)
            raw = pa.array([v.tobytes() for v in x], pa.binary())
            for t in range(trees):
                yield pa.RecordBatch.from_pydict({"leaf": f.leaf(x, t) + t * leaves, "vec_id": b.column("vec_id"), "x": raw})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = _matrix(b.column("vec")).reshape(len(b), dim)
            got = [[t * leaves + i for t, i in g] for g in f.probe(x, probes)]
            yield pa.RecordBatch.from_pydict({"query_id": b.column("vec_id"), "q": pa.array([v.tobytes() for v in x], pa.binary()), "leaf": pa.array(got, pa.list_(pa.int64()))})

    fits = F.size("vec") == dim
    dealt = stage.table("leaves", base.filter(fits).distinct().mapInArrow(deal, "leaf long, vec_id long, x binary"))
    visits = stage.table("queries", asked.filter(fits).distinct().mapInArrow(ask, "query_id long, q binary, leaf array<long>"))
    # at most trees x leaves rows each
    held = {r.leaf: r.n for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    wanted = {r.leaf: r.n for r in visits.select(F.explode("leaf").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    work = sum(held[i] * n for i, n in wanted.items() if i in held) / (GROUPS * parts(spark))
    size = []
    for i, n in wanted.items():
        if i in held:
            in_blocks = -(-n // ASKED)
            size.append((i, in_blocks, min(-(-held[i] // CELL), int(np.ceil(held[i] * n / in_blocks / work)))))
    size = F.broadcast(spark.createDataFrame(size, "leaf long, blocks long, cells long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    base_ = dealt.join(size, "leaf").select("leaf", every("blocks").alias("block"), F.pmod(F.xxhash64("vec_id", "x"), F.col("cells")).alias("cell"), F.lit(1).alias("side"), F.col("vec_id").alias("id"), "x")
    queries_ = visits.select(F.explode("leaf").alias("leaf"), "query_id", "q").join(size, "leaf")
    queries_ = queries_.select("leaf", F.pmod(F.xxhash64("query_id", "q"), F.col("blocks")).alias("block"), every("cells").alias("cell"), F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("q").alias("x"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, Block(k, dim)
        for b in batches:
            ids, x = b.column("id").to_numpy(), np.frombuffer(b"".join(b.column("x").to_pylist()), np.float64).reshape(-1, dim)
            for (*key, side), lo, hi in _runs(b, ["leaf", "block", "cell", "side"]):
                if key != at:
                    yield from block.nearest()
                    at, block = key, Block(k, dim)
                if side == 0:
                    block.ask(ids[lo:hi], x[lo:hi])
                elif block.asked:
                    block.meet(ids[lo:hi], x[lo:hi])
        yield from block.nearest()

    # a group's queries come before its rows
    near = queries_.unionByName(base_).repartition("leaf", "block", "cell").sortWithinPartitions("leaf", "block", "cell", "side").mapInArrow(meet, "query_id long, vec_id long, score double")

    def nearest(key: tuple, t: pa.Table) -> pa.Table:
        v, s = t["vec_id"].to_numpy(), t["score"].to_numpy()
        v, first = np.unique(v, return_index=True)
        s = s[first]
        best = np.lexsort((v, -s))[:k]
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(best), pa.int64()), "rank": pa.array(np.arange(1, len(best) + 1), pa.int32()), "vec_id": v[best], "score": s[best]})

    return near.groupBy("query_id").applyInArrow(nearest, schema)


def recall(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 20) -> float:
    """Share of the exact k nearest that were found; every query is held against all rows, in blocks."""
    spark = rows.sparkSession
    base, asked = usable(rows).distinct(), usable(queries).distinct()
    n = parts(spark)
    left = base.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("cell"))
    right = asked.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).groupBy("cell")

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        score = dot(_matrix(b["vec"].combine_chunks()), _matrix(a["vec"].combine_chunks()))
        score[b["vec_id"].to_numpy()[:, None] == a["vec_id"].to_numpy()[None, :]] = -np.inf
        best = -np.sort(-score, axis=1)[:, :k]
        return pa.table({"query_id": np.repeat(b["vec_id"].to_numpy(), best.shape[1]), "score": best.reshape(-1)})

    exact = left.cogroup(right).applyInArrow(meet, "query_id long, score double").filter("score > double('-inf')")
    least = exact.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.slice("s", 1, k).alias("s"))
    both = least.join(found.groupBy("query_id").agg(F.collect_list("score").alias("got")), "query_id", "left")
    hit = F.size(F.filter(F.coalesce("got", F.array().cast("array<double>")), lambda x: x >= F.element_at("s", -1)))
    row = both.select(F.sum(F.least(hit, F.size("s"))).alias("hit"), F.sum(F.size("s")).alias("all")).first()
    return row.hit / row.all
