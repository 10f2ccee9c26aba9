import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import langid, registry
from tests.llm.conftest import ODD


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op5_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows_and_bound(make_docs):
    docs = make_docs([*ODD, (20, "the cat and the dog", "en"), (21, "der hund und die katze", "de"), (22, "12 34 !!", None)])
    model = langid.fit(docs.filter("doc_id >= 20"), max_fit=1000)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1] == by[2] == by[3] == by[22] == ("und", 0.0)
    assert by[20][0] == "en" and by[21][0] == "de"
    none = langid.fit(docs.filter(F.lit(False)))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    few = langid.fit(docs.unionByName(docs).unionByName(docs), max_fit=5)
    assert few.logp.shape[0] == langid.FEATURES


def test_by_plain_naive_bayes(make_docs):
    """Counts in dictionaries, features by the same hash, probabilities added up one by one."""
    rnd = random.Random(2)
    words = {"en": ["the", "cat", "House", "of"], "de": ["der", "Straße", "und", "Haus"], "fr": ["le", "été", "maison", "et"]}
    rows = [(i, " ".join(rnd.choice(words[x] + ["12", "x!"]) for _ in range(rnd.randrange(1, 12))), x) for i in range(90) for x in [rnd.choice(list(words))]]
    docs = make_docs(rows)
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs.filter("doc_id < 60"))).collect()}

    def grams(text):
        t = re.sub(r"[^\W\d_]+|.", lambda m: m[0].lower() if m[0][0].isalpha() else " ", text, flags=re.S)
        t = [ord(c) for c in re.sub(" +", " ", t)]
        for k in range(langid.ORDERS):
            for i in range(len(t) - k):
                code = 0
                for c in t[i : i + k + 1]:
                    code = (code * 0x110001 + c) % (1 << 64)
                x = (code + (k << 50)) % (1 << 64)
                x ^= x >> 30
                x = x * 0xBF58476D1CE4E5B9 % (1 << 64)
                x ^= x >> 27
                x = x * 0x94D049BB133111EB % (1 << 64)
                yield (x ^ x >> 31) % langid.FEATURES

    count, docs_of = {x: Counter() for x in words}, Counter()
    for d, t, x in rows:
        if d < 60:
            count[x].update(grams(t))
            docs_of[x] += 1
    for d, t, _ in rows:
        logp = {x: math.log(docs_of[x] / sum(docs_of.values())) + sum(math.log((count[x][f] + langid.PRIOR) / (sum(count[x].values()) + langid.PRIOR * langid.FEATURES)) for f in grams(t)) for x in words}
        best = max(sorted(logp), key=logp.get)
        assert got[d].lang_pred == best or not any(c.isalpha() for c in t)
        if any(c.isalpha() for c in t):
            assert got[d].score == pytest.approx(1 / sum(math.exp(v - logp[best]) for v in logp.values()), rel=1e-6)


def test_empty(make_docs):
    docs = make_docs([])
    assert langid.identify(docs, langid.fit(docs)).count() == 0
