import hashlib
import random

from plumbline.llm import byte_dedup, registry
from tests.llm.conftest import ODD

LAST = 1 << 63


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    ids = [LAST if d is None else d for d, _ in rows]
    first = {}
    for d, b in zip(ids, data):
        for i in range(len(b) - length + 1):
            key, at = b[i : i + length], (d, i)
            if key not in first or at < first[key]:
                first[key] = at
    out = []
    for (d, _), m, b in zip(rows, ids, data):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (m, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, registry.op8_byte_dedup(spark, sf).collect()), key=str)
    want = brute(rows, 100)
    assert got == want
    assert sum(x[2] for x in want) > 0


def test_small_lengths_runs_and_overlaps(make_docs):
    rnd = random.Random(9)
    rows, texts = [], [""]
    for d in range(150):
        w = "".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(0, 400)))
        for _ in range(rnd.randrange(3)):
            src = rnd.choice(texts)
            a = rnd.randrange(len(src) + 1)
            w = w[: len(w) // 2] + src[a : a + rnd.randrange(200)] + w[len(w) // 2 :]
        if rnd.random() < 0.3:
            w += "z" * rnd.randrange(150) + "pq" * rnd.randrange(90)
        texts.append(w)
        rows.append((d, w))
    rows += [(r[0] + 1000 if r[0] else r[0], r[1]) for r in ODD]
    for length in (20, 40, 100):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in byte_dedup.dedup(make_docs(rows), length).collect()]
        assert sorted(got, key=str) == brute(rows, length)


def test_empty(make_docs):
    assert byte_dedup.dedup(make_docs([])).count() == 0
