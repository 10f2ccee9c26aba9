import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm_score, registry
from tests.llm.conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_base_score_by_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tok = {d: [*WORDS.findall(lower(t)), None] for d, t in docs.items()}
    train = {d for d in docs if zlib.crc32(str(d).encode()) % 10}
    c = Counter(x for d in train for x in tok[d])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in registry.op10_lm_score(spark, sf).collect()}
    assert set(got) == set(docs)
    for d, r in got.items():
        assert r.held_out == (d not in train)
        assert r.n_tokens == len(tok[d])
        assert r.n_known == sum(c[x] > 0 for x in tok[d])
        assert r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tok[d]), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_model_is_a_mixture_and_em_recovers_weights():
    rows = [(1, lm_score._bin(lm_score.np.array([8.0]))[0], 0, 70.0), (1, 0, 0, 30.0)]
    w = lm_score.fit_weights(rows)[1]
    assert math.isclose(sum(w), 1) and w[0] > 0.5 and w[1] < 0.01


def test_score_by_plain_interpolation(make_docs):
    """The model's score from plain dictionaries: bigram, word and uniform shares, EM over deleted counts in the same bins."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("aaaabbbccd") + rnd.choice("xy") for _ in range(rnd.randrange(0, 40)))) for i in range(120)]
    rows.append((500, rows[3][1]))
    train = {d for d, _ in rows if d % 5}
    tok = {d: [*WORDS.findall(lower(t)), None] for d, t in rows}
    pairs = {d: list(zip([None, *t[:-1]], t)) for d, t in tok.items()}
    word, two = Counter(x for d in train for x in tok[d]), Counter(x for d in train for x in pairs[d])
    n, flat = sum(word.values()), 1 / (len(word) + 1)
    bins = Counter()
    bucket = lambda c: int(math.log2(c)) + 1 if c > 0 else 0
    one_bin = lambda x: int(lm_score._bin(lm_score.np.array([x]))[0])
    for d in train:
        own, own2 = Counter(tok[d]), Counter(pairs[d])
        for a, b in pairs[d]:
            left = word[a] - own[a]
            bins[bucket(left), one_bin((two[a, b] - own2[a, b]) / left / flat if left else 0.0), one_bin((word[b] - own[b]) / n / flat)] += 1
    weights = lm_score.fit_weights([(*k, c) for k, c in bins.items()])
    got = lm_score.score(make_docs(rows).withColumn("train", F.col("doc_id") % 5 != 0)).collect()
    for r in got:
        want = 0.0
        for a, b in pairs[r.doc_id]:
            w = weights.get(bucket(word[a]), (0.0, 0.5, 0.5))
            want += math.log10(w[0] * (two[a, b] / word[a] if word[a] else 0.0) + w[1] * word[b] / n + w[2] * flat)
        assert r.score == pytest.approx(want, rel=1e-9)


def test_odd_rows(make_docs):
    docs = make_docs(ODD).withColumn("train", F.col("doc_id") != 5)
    got = lm_score.score(docs).collect()
    assert len(got) == len(ODD)
    empty = [r for r in got if r.doc_id in (1, 2, 3)]
    assert all(r.n_tokens == 1 and r.score < 0 for r in empty)
    assert {r.train_tokens for r in got} == {1 + 1 + 1 + 2 + 2 + 30001 + 3}  # doc 5 and the null flag are left out


def test_empty(make_docs):
    assert lm_score.score(make_docs([]).withColumn("train", F.lit(True))).count() == 0
