import hashlib
import random
import zlib

import pytest

from plumbline.llm import media, registry
from plumbline.llm._stage import Stage
from tests.llm.conftest import ODD


def expected(text):
    raw = (text or "").encode()
    data = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])


def test_query_round_trip(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op6_media(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(docs[r.doc_id])


def test_shared_chunks_are_stored_once(make_docs, spark):
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(60000))
    rows = [(i, "".join(rnd.choice("xyz ") for _ in range(900 * i)) + passage) for i in range(30, 40)] + ODD + [(50, passage), (51, passage)]
    docs = make_docs(rows)
    stage = Stage(spark, "media-test")
    files = media.store(docs, stage)
    held = files.selectExpr("inline(lent)")
    assert held.count() == held.select("digest").distinct().count() > 0
    assert files.selectExpr("aggregate(own, 0L, (a, x) -> a + if(x is null, 1, 0)) n").groupBy().sum("n").first()[0] > held.count()
    got = media.round_trip(docs, media.DIGESTS + ("media",)).collect()
    by = {d: t for d, t in rows if d is not None}
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(by[r.doc_id])
        assert hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes


def test_cuts_follow_content():
    data = bytes(random.Random(1).choices(range(256), k=400_000))
    ends = media.cuts(data)
    assert ends[-1] == len(data) and all(media.LEAST <= b - a <= media.GREATEST for a, b in zip(ends, ends[1:-1]))
    later = {e + 1000 for e in ends}
    assert len(later & set(media.cuts(b"q" * 1000 + data))) > len(ends) * 0.8
    with pytest.raises(ValueError):
        media.decode(b"P5\n576 2\n255\nxx")


def test_empty(make_docs):
    assert media.round_trip(make_docs([])).count() == 0
