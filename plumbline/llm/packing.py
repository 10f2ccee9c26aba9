"""Packing of tokenized documents along a space-filling curve (operator 7).

Documents are tokenized once. The hashed counts of a document's tokens are projected to a few
dimensions; the direction of that vector gives a key on a Hilbert curve, so documents that are
near on the curve are alike. A range sort by the key (ties by doc_id) lays all documents on one
line, which is cut every ``length`` tokens; the last, shorter stretch is cut into powers of two.
No sequence has padding, and neighbours on the curve share sequences.

Only the sort keys and lengths are sorted; a document's place on the line follows from its
place in its sorted partition and the totals of the partitions before it. The tokens are
joined to the places afterwards.

Cases: null text is empty and has the closing id alone; a null doc_id is packed like any
other (first on the curve among its ties); repeated rows are packed each on its own; a very
long text is cut into as many pieces as it needs; extra columns are ignored; an empty table
returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _tally as Q
from plumbline.llm import _text as T
from plumbline.llm._memo import Memo
from plumbline.llm._stage import Stage, parts

LENGTH, CLOSE = 4096, 2
DIMENSIONS, BITS = 3, 10


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII characters that no token of a word tokenizer joins with a letter beside them; an apostrophe may start a token.
APART = ~LETTER & ~T.SPACE & (np.arange(256) < 128) & (np.arange(256) != 39)


class Words:
    """Token ids of texts by a lower-casing tokenizer that splits at white space and around letters.

    It is asked once per distinct stretch: a word, cut where an ASCII letter and another ASCII
    character meet. Stretches are asked for in groups, with a special token between them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = min(self.tokenizer.get_added_tokens_decoder().items())
        self.mark, self.between = special[0], special[1].content
        self.memo = Memo(self.ask, lower=True)

    def ask(self, spans: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for lo in range(0, len(spans), 8192):
            texts = [b.decode("utf-8", "replace") for b in spans[lo : lo + 8192]]
            for x in self.tokenizer.encode_batch_fast([self.between.join(texts[i : i + 16]) for i in range(0, len(texts), 16)], add_special_tokens=False):
                ids, at = x.ids, 0
                while self.mark in ids[at:]:
                    end = ids.index(self.mark, at)
                    out.append(ids[at:end])
                    at = end + 1
                out.append(ids[at:])
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the rows' offsets among them."""
        s, e, _ = T.words(buf, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        letter, apart = LETTER[buf], APART[buf]
        first, last = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        first[1:] = letter[1:] & apart[:-1] | apart[1:] & letter[:-1]
        first[off[(off > 0) & (off < len(buf))]] = False
        last[:-1] = first[1:]
        first[s], last[e - 1] = True, True
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        ids, at = self.memo.ids_of(buf, s, e)
        return ids, at[np.searchsorted(s, off)]


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates (Skilling's transform)."""
    x = x.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | (x[i] >> b & 1)
    return out


def curve(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each row's Hilbert key; a row without tokens stands at the centre."""
    code = T.mix(ids.astype(T.U) + T.U(77))
    total = np.zeros((len(off) - 1, DIMENSIONS))
    full = np.flatnonzero(np.diff(off))
    for d in range(DIMENSIONS):
        part = (code >> T.U(21 * d) & T.U((1 << 21) - 1)).astype(np.float64) / (1 << 20) - 1
        if len(full):
            total[full, d] = np.add.reduceat(part, off[full])
    norm = np.maximum(np.sqrt((total**2).sum(1)), 1e-12)[:, None]
    return hilbert(np.clip((total / norm + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1))


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release()
        for batch in batches:
            buf, off = T.bytes_of(batch.column("text"))
            for lo, hi in T.slices(off):
                ids, w = words(path).encode(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                key = curve(ids, w)
                packed = [Q.pack(Q.small(np.append(ids[a:b], np.uint32(CLOSE)))) for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "curve": key, "n": np.diff(w) + 1, "ids": pa.array(packed, pa.binary())})

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, base = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        before = base + np.cumsum(n) - n
        base += int(n.sum())
        yield pa.RecordBatch.from_pydict({"rid": batch.column("rid"), "part": np.full(len(n), part), "before": before, "n": n})


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    stage = Stage(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tokens = stage.table("tokens", rows.mapInArrow(_tokens(path), "doc_id long, curve long, n long, ids binary").withColumn("rid", F.monotonically_increasing_id()))
    light = tokens.select("curve", "doc_id", "rid", "n").repartitionByRange(parts(spark), "curve", "doc_id", "rid").sortWithinPartitions("curve", "doc_id", "rid")
    place = stage.table("places", light.select("rid", "n").mapInArrow(_places, "rid long, part long, before long, n long"))
    sizes = {r.part: r.n for r in place.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a partition
    base, total = [], 0
    for p in sorted(sizes):
        base.append((p, total))
        total += sizes[p]
    place = place.join(F.broadcast(spark.createDataFrame(base, "part long, base long")), "part").select("rid", (F.col("base") + F.col("before")).alias("at"))
    # the last stretch, cut into powers of two
    tail = [total - total % length]
    for b in range(length.bit_length() - 1, -1, -1):
        if total % length >> b & 1:
            tail.append(tail[-1] + (1 << b))
    edges, whole = np.array(tail), total // length

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for doc, packed, at in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("at").to_pylist(), strict=True):
                ids = Q.unpack(packed, np.uint32)
                cut = [at, *range(at - at % length + length, min(at + len(ids), tail[0] + 1), length), *(x for x in tail if at < x < at + len(ids)), at + len(ids)]
                cut = sorted(set(cut))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    k = int(np.searchsorted(edges, a, "right")) - 1
                    seq, first = (a // length, a - a % length) if a < tail[0] else (whole + k, tail[k])
                    for c, v in zip(out, (doc, a - at, b - a, ids[a - at : b - at].astype("<u4").tobytes(), len(ids), seq, a - first), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()})

    return tokens.select("rid", "doc_id", "ids").join(place, "rid").select("doc_id", "ids", "at").mapInArrow(
        pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
