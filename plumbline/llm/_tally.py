"""Corpus-wide questions about hashed keys, asked by blocks of rows and answered by buckets.

A block (a bounded group of rows) asks about its distinct 64-bit keys, in ascending order,
with one or more integer values per key. Keys are dealt to buckets by their leading bits; a
bucket sees what all blocks know of its keys, and answers every block in the order it asked.
Both directions are ordinary ``groupBy(...).applyInArrow`` steps whose rows carry compressed
arrays, so a key that fills a third of the corpus is one entry per block, never a hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

U = np.uint64
ASK = "block int, bucket int, kind int, n long, keys binary, vals array<binary>"
ASK_PA = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("vals", pa.list_(pa.binary()))])


_squeeze = zstandard.ZstdCompressor(level=1)


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    a = np.ascontiguousarray(a)
    width = a.dtype.itemsize
    return bytes([width]) + _squeeze.compress(a.view(np.uint8).reshape(-1, width).T.tobytes())


def unpack(b: bytes, dtype: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(bytearray(zstandard.ZstdDecompressor().decompress(b[1:])), np.uint8)
    return np.ascontiguousarray(raw.reshape(b[0], -1).T).reshape(-1).view(f"u{b[0]}" if b[0] < 8 else np.int64).astype(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U), dtype=U)


def small(a: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest unsigned type that holds them, else as int64."""
    top = int(a.max()) if len(a) else 0
    if len(a) and a.min() < 0:
        return a.astype(np.int64)
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.int64)


def asks(block: int, kind: int, keys: np.ndarray, vals: list[np.ndarray], n_buckets: int) -> Iterator[dict]:
    """Rows that ask about sorted keys; a key may come again only with another check among its values."""
    edges = np.array([(b << 64) // n_buckets if b < n_buckets else (1 << 64) - 1 for b in range(n_buckets + 1)], U)
    at = np.searchsorted(keys, edges)
    at[-1] = len(keys)
    for b in np.flatnonzero(np.diff(at)):
        lo, hi = at[b], at[b + 1]
        yield {"block": block, "bucket": int(b), "kind": kind, "n": int(hi - lo), "keys": pack_sorted(keys[lo:hi]), "vals": [pack(small(v[lo:hi])) for v in vals]}


def table_of(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=ASK_PA)


Reduce = Callable[[int, np.ndarray, list[np.ndarray]], tuple[list[np.ndarray], list[int]]]


def answers(asked: DataFrame, reduce: Reduce) -> DataFrame:
    """Each ask's row with its keys left out and the answers as vals.

    reduce(kind, group, vals) gets, for all entries of a bucket, the number of the distinct
    key that each stands for (0, 1, ... in key order) and the values; it returns answer
    arrays with one value per entry, and integers that describe the bucket as a whole, which
    are sent once (as a row of block -1).
    """

    def one(key: tuple, t: pa.Table) -> pa.Table:
        blocks, counts = t["block"].to_pylist(), t["n"].to_pylist()
        keys = np.concatenate([unpack_sorted(k) for k in t["keys"].to_pylist()])
        vals = t["vals"].to_pylist()
        cols = [np.concatenate([unpack(v[i]) for v in vals]) for i in range(len(vals[0]))]
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        bucket, kind = key[0].as_py(), key[1].as_py()
        got, whole = reduce(kind, group, cols)
        out, at = [], 0
        for b, n in zip(blocks, counts, strict=True):
            out.append({"block": b, "bucket": bucket, "kind": kind, "n": n, "keys": None, "vals": [pack(small(x[at : at + n])) for x in got]})
            at += n
        if whole:
            out.append({"block": -1, "bucket": bucket, "kind": kind, "n": 0, "keys": None, "vals": [pack(np.array([x], np.int64)) for x in whole]})
        return table_of(out)

    return asked.groupBy("bucket", "kind").applyInArrow(one, ASK)


def replies(t: pa.Table, kind: int, which: int = 0) -> np.ndarray:
    """What a block got for all its keys of one kind, in key order."""
    rows = sorted((b, v[which]) for b, k, v in zip(t["bucket"].to_pylist(), t["kind"].to_pylist(), t["vals"].to_pylist(), strict=True) if k == kind)
    return np.concatenate([unpack(v) for _, v in rows]) if rows else np.zeros(0, np.int64)


def sums(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.bincount(group, values, minlength=int(group.max()) + 1 if len(group) else 0).astype(np.int64)


def pairs(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in ascending order of (key, check), where each distinct pair starts in that order, and each entry's pair's number."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], check[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if (c[1:] != c[:-1])[~new[1:]].any():  # keys have collided
        order = np.lexsort((check, keys))
        k, c = keys[order], check[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def finer(group: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Groups told apart by a second hash as well, where the first one has collided."""
    first = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
    first[group] = check
    if (first[group] == check).all():
        return group
    return np.unique(np.stack([group, check]), axis=1, return_inverse=True)[1].reshape(-1)


def minima(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(out, group, values)
    return out
