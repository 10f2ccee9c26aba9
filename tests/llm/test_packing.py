import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import packing, registry
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry._vocabulary("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def check(pieces, ids, length):
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append(p)
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at == length or at & (at - 1) == 0
    for d, want in ids.items():
        at = 0
        for p in sorted(docs[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    assert set(docs) == set(ids)


def test_query_by_tokenizer(spark, sf, tokenizer):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {r.doc_id: [*e.ids, 2] for r, e in zip(rows, tokenizer.encode_batch([r.text for r in rows], add_special_tokens=False))}
    got = registry.op7_packing(spark, sf).collect()
    check(got, ids, 4096)
    assert len({p.sequence_id for p in got}) <= sum(map(len, ids.values())) // 4096 + 12


def test_odd_rows(make_docs, spark, tokenizer):
    odd = [(i, r[1]) for i, r in enumerate(ODD)] + [(99, "<|endoftext|> É́e x'll 12ab")]
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in odd}
    got = packing.pack(make_docs([*odd, (None, "x")]), registry._vocabulary("word_bpe_49k.json"), 64)
    rows = got.withColumn("ids_crc32", registry.F.crc32("ids")).collect()
    assert [r.doc_tokens for r in rows if r.doc_id is None][0] == 2
    check(rows, ids | {None: [*tokenizer.encode("x", add_special_tokens=False).ids, 2]}, 64)


def test_empty(make_docs):
    assert packing.pack(make_docs([]), registry._vocabulary("word_bpe_49k.json")).count() == 0


def test_hilbert_visits_neighbours():
    n = 8
    grid = np.stack(np.meshgrid(*[np.arange(n)] * 3), -1).reshape(-1, 3)
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
