"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 5).

Letters are lower-cased and every stretch of other characters becomes one space; n-grams of one
to three characters are hashed to a fixed number of features. Counts per language are fitted on
a bounded sample of labelled documents (``max_fit``, chosen by a hash of doc_id; 20,000 in
production), merged in Spark, and the matrix of log-probabilities (features x languages) is
broadcast. Batches are scored in numpy over whole texts.

Cases: a text that is null or has no letter is ``und`` with score 0, as is every text when no
labelled row was given; equal scores go to the first language by name; rows whose label is null
are not learned from; a null doc_id is scored but not learned from; repeated rows each return
a row; a very long text is scored whole; extra columns are carried through, but lang_pred and
score are replaced unless another column is named for the answer; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.llm import _tally as Q
from plumbline.llm import _text as T
from plumbline.llm._stage import small_batches

FEATURES, ORDERS, PRIOR, MAX_FIT = 1 << 15, 3, 0.5, 20_000
#: Bytes of text of one numpy pass: an n-gram takes some 100 bytes while it is scored.
PASS = 1 << 18
COUNTS = "lang string, slot int, docs long, counts binary"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams row by row, the rows' offsets, and whether a row has a letter."""
    n = len(off) - 1
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))  # characters before each byte
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    c = _letters()[chars] if len(chars) else chars
    row = np.repeat(np.arange(n), np.diff(lead[off]))[: len(c)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])
    c, row = c[keep].astype(T.U), row[keep]
    letter = np.zeros(n, bool)
    letter[row[c != 32]] = True
    feats, rows = [], []
    code = np.zeros(len(c), T.U)
    for k in range(ORDERS):
        m = len(c) - k
        if m <= 0:
            break
        code = code[:m] * T.U(0x110001) + c[k:]
        same = row[:m] == row[k:]
        feats.append((T.mix(code + T.U(k << 50)) % T.U(FEATURES))[same].astype(np.int64))
        rows.append(row[:m][same])
    f = np.concatenate([np.zeros(0, np.int64), *feats])
    r = np.concatenate([np.zeros(0, np.int64), *rows])
    order = np.argsort(r, kind="stable")
    return f[order], np.searchsorted(r[order], np.arange(n + 1)), letter


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    T.release()
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        buf, off = T.bytes_of(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for lo, hi in T.slices(off, PASS):
            f, w, _ = features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            row = T.owners(w)
            for name in sorted(set(langs[lo:hi])):
                mine = np.array([x == name for x in langs[lo:hi]])
                total[name] = total.get(name, 0) + np.bincount(f[mine[row]], minlength=FEATURES)
                docs[name] = docs.get(name, 0) + int(mine.sum())
    slot = TaskContext.get().partitionId()
    for name, c in total.items():
        yield pa.RecordBatch.from_pydict({"lang": [name], "slot": pa.array([slot], pa.int32()), "docs": [docs[name]], "counts": [Q.pack(Q.small(c))]})


def _merge(key: tuple, t: pa.Table) -> pa.Table:
    c = sum(Q.unpack(x) for x in t["counts"].to_pylist())
    return pa.table({"lang": [key[0].as_py()], "slot": pa.array([0], pa.int32()), "docs": [sum(t["docs"].to_pylist())], "counts": [Q.pack(Q.small(c))]})


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.logp, self.prior = langs, logp, prior

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each row (-1: und), and its posterior probability."""
        f, w, letter = features(buf, off)
        n = len(off) - 1
        best, score = np.full(n, -1), np.zeros(n)
        full = np.flatnonzero(letter)
        if len(full) and self.langs:
            keep = np.flatnonzero(np.diff(w) > 0)
            total = np.add.reduceat(self.logp[f], w[keep], axis=0)[np.searchsorted(keep, full)] + self.prior
            best[full] = total.argmax(1)
            total -= total.max(1, keepdims=True)
            score[full] = 1 / np.exp(total).sum(1)
        return best, score


def fit(labelled: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """Learn from doc_id, text and lang (rows where one is null are skipped)."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null")
    share = min(1.0, max_fit / max(1, rows.count()))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    counts = chosen.select("text", "lang").mapInArrow(_count, COUNTS)
    # tasks' counts meet in groups of a bounded number of rows, then by language
    part = counts.groupBy("lang", F.pmod("slot", F.lit(64)).alias("pile")).applyInArrow(_merge, COUNTS)
    got = {r.lang: r for r in part.groupBy("lang").applyInArrow(_merge, COUNTS).collect()}  # a row a language
    langs = sorted(got)
    if not langs:
        return Model([], np.zeros((FEATURES, 0)), np.zeros(0))
    c = np.stack([Q.unpack(bytes(got[x].counts)) for x in langs], 1) + PRIOR
    docs = np.array([got[x].docs for x in langs], float)
    return Model(langs, np.log(c / c.sum(0)), np.log(docs / docs.sum()))


def identify(docs: DataFrame, model: Model, into: str | None = None) -> DataFrame:
    """All columns of docs with lang_pred and score, which replace columns of these names; or as the fields of one new column ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers
    small_batches(docs.sparkSession)
    told = StructType().add("lang_pred", "string").add("score", "double")
    if into is None:
        docs = docs.drop(*told.names)
    schema = StructType([*docs.schema.fields, *(told.fields if into is None else [StructField(into, told)])])
    text = docs.columns.index("text")
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])  # names may hold any signs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release()
        m = shared.value
        names = pa.array([*m.langs, "und"], pa.string())
        for batch in batches:
            buf, off = T.bytes_of(batch.column(text))
            got = [m.predict(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in T.slices(off, PASS)]
            best = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in got)])
            new = {"lang_pred": names.take(pa.array(np.where(best < 0, len(m.langs), best))), "score": pa.array(np.concatenate([np.zeros(0), *(b for _, b in got)]))}
            if into is not None:
                new = {into: pa.StructArray.from_arrays([*new.values()], names=[*new])}
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=plain.names)

    return docs.toDF(*plain.names[: len(docs.columns)]).mapInArrow(run, plain).toDF(*schema.names)
