import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from plumbline.llm import pieces, registry
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=registry._vocabulary("piece_bpe_32k.model"))


def test_query_by_library(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op9_sentencepiece(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_texts_by_library(make_docs, library):
    rnd = random.Random(8)
    texts = [t for _, t in ODD] + ["x" + " " * n + "the" + " " * (n // 2) for n in range(0, 60)] + ["日本語 テスト ✓ 😀\U0001f9ff", "▁a ▁", "<s> </s> <unk> <0x41>", "a\n\n b\t c", "ﬁ ½ ①", "aaaaaaaaaaaaaaaaaaaaaaa" * 9]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz  .,-'éüñ\n0123") for _ in range(200)) for _ in range(200)]
    rows = list(enumerate(texts))
    path = registry._vocabulary("piece_bpe_32k.model")
    got = pieces.decode(pieces.encode(make_docs(rows), path), path).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(t), t
        assert bytes(r.decoded).decode() == t.replace(pieces.MARK, " ")


def test_only_one_path_of_a_byte_pair_machine_is_finite(library):
    """All cuts of a segment into pieces: merging's is the only one whose arcs are all finite, and the shortest path finds it."""
    m, _ = pieces.machine(registry._vocabulary("piece_bpe_32k.model"))
    rnd = random.Random(1)

    def cuts(text):
        return [[]] if not text else [[m.id[text[:k]], *rest] for k in range(1, len(text) + 1) if text[:k] in m.id for rest in cuts(text[k:])]

    for _ in range(60):
        w = pieces.MARK + "".join(rnd.choice(["the", "ing", "er", "on", "th", "x", "q"]) for _ in range(rnd.randrange(1, 4)))
        finite = [c for c in cuts(w[:9]) if all(m.allowed(a, b) for a, b in zip(c, c[1:]))]
        assert finite == [m.shortest(w[:9])] == [library.encode(w[1:9])]


def test_inverse_undoes_ids_of_any_text(library):
    texts = ["", " ", "a  b", " \n\t", "日本 \x00\x01", "the" * 40]
    ids = [library.encode(t) for t in texts]
    off = np.concatenate(([0], np.cumsum(list(map(len, ids)))))
    data, at = pieces.inverse(registry._vocabulary("piece_bpe_32k.model")).decode(np.array(sum(ids, []), np.uint32), off)
    assert [data[a:b].decode() for a, b in zip(at, at[1:])] == texts


def test_empty(make_docs):
    assert pieces.encode(make_docs([]), registry._vocabulary("piece_bpe_32k.model")).count() == 0
