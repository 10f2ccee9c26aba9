"""Texts made to collide: Thue-Morse strings and their complements hash alike under any polynomial modulo 2**64."""

import hashlib
import zlib

import numpy as np
import pytest

from plumbline.llm import _memo, _text, byte_dedup, lm_score, ngram_join, packing, pieces, registry, substring_dedup
from tests.llm import test_byte_dedup, test_ngram_join, test_substring_dedup


def morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


WORDS = [morse(n, *ab) for n in (1024, 2048) for ab in ("ab", "ba")]
#: Passages of 60 words, each text with another one of the words that collide.
ROWS = [(i + 1, " ".join([w, *(f"w{j}" for j in range(29)), w, *(f"v{j}" for j in range(29))])) for i, w in enumerate(WORDS)]
ROWS += [(10 + i, " ".join(w if x == "a" else v for x in morse(2048))) for i, (w, v) in enumerate((("x", "y"), ("y", "x")))]
ROWS += [(20 + i, f"{w} {w[::-1]} {'z' * 40}") for i, w in enumerate(WORDS)]


def test_hashes_tell_them_apart():
    buf = np.frombuffer("".join(WORDS).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in WORDS])
    for lane in (0, 1):
        assert len(set(_text.span_hash(buf, ends - [len(w) for w in WORDS], ends, lane).tolist())) == len(WORDS)
    h = _text.mix(np.array([1, 2], np.uint64))[np.array([c == "b" for c in morse(4096) + morse(4096, "b", "a")]).astype(int)]
    assert len(set(_text.runs(h, np.array([0, 4096]), np.array([4096, 4096])).tolist())) == 2
    assert len(set(_text.windows(h, np.array([0, 4096]), 2048).tolist())) == 2


def test_joins_and_removals_by_brute_force(make_docs):
    docs = make_docs(ROWS)
    assert sorted((tuple(r) for r in ngram_join.join(docs).collect()), key=str) == test_ngram_join.brute(ROWS)
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept")) for r in substring_dedup.dedup(docs).collect()]
    assert sorted(got, key=str) == test_substring_dedup.brute(ROWS, 50)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in byte_dedup.dedup(docs).collect()]
    assert sorted(got, key=str) == test_byte_dedup.brute(ROWS, 100)


def test_tokens_by_libraries(make_docs):
    import sentencepiece
    from tokenizers import Tokenizer

    path = registry._vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(make_docs(ROWS), path).withColumn("crc", registry.F.crc32("ids")).collect()
    for d, text in ROWS:
        want, own = [*t.encode(text, add_special_tokens=False).ids, 2], sorted((p for p in got if p.doc_id == d), key=lambda p: p.start)
        assert [p.crc for p in own] == [zlib.crc32(np.array(want[p.start : p.start + p.length], "<u4").tobytes()) for p in own] and own[-1].start + own[-1].length == len(want)
    path = registry._vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode(make_docs(ROWS), path).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(dict(ROWS)[r.doc_id])


def test_words_are_counted_apart(make_docs):
    docs = make_docs(ROWS[:4]).withColumn("train", registry.F.col("doc_id") == 1)
    got = {r.doc_id: r for r in lm_score.score(docs).collect()}
    assert [got[i].n_known for i in (1, 2, 3, 4)] == [61 - 0, 59, 59, 59]


@pytest.mark.parametrize("lower", [False, True])
def test_memo_compares_bytes(monkeypatch, lower):
    monkeypatch.setattr(_text, "_sum", lambda x, place, first, size, which: np.zeros(len(first), np.uint64))
    words = ["Abc", "abc", "abd", "x" * 20, "x" * 19 + "y", "abc"]
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    e = np.cumsum([len(w) for w in words])
    m = _memo.Memo(lambda spans: [[len(x), x[0], x[-1]] for x in spans], lower)
    for _ in range(2):
        ids, at = m.ids_of(buf, e - [len(w) for w in words], e)
        want = [w.lower().encode() if lower else w.encode() for w in words]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[len(w), w[0], w[-1]] for w in want]
