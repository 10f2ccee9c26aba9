import hashlib
import random
import re

from plumbline.llm import registry, substring_dedup
from tests.llm.conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept) for each row."""
    words = [WORDS.findall(t or "") for _, t in rows]
    ids = [LAST if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(ids, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, LAST), d)
    out = []
    for (d, _), m, w in zip(rows, ids, words):
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < m:
                keep[i : i + window] = [False] * window
        kept = [x for x, k in zip(w, keep) if k]
        out.append((d, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=str)


def test_query_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in brute(rows, 50)]
    assert sorted(map(tuple, registry.op3_substring_dedup(spark, sf).collect()), key=str) == sorted(want, key=str)
    assert sum(r for _, _, r, _ in want) > 0


def test_small_windows_runs_and_overlaps(make_docs):
    rnd = random.Random(5)
    rows = []
    for d in range(120):
        w = [rnd.choice("abc") if rnd.random() < 0.5 else str(rnd.randrange(40)) for _ in range(rnd.randrange(0, 60))]
        if rows and rnd.random() < 0.6:
            src = (rnd.choice(rows)[1] or "").split()
            a = rnd.randrange(len(src) + 1)
            w[len(w) // 2 :] = src[a : a + rnd.randrange(30)]
        if rnd.random() < 0.2:
            w += ["x"] * rnd.randrange(40) + ["p", "q"] * rnd.randrange(20)
        rows.append((rnd.randrange(100), "\t ".join(w)))
    rows += ODD
    for window in (5, 12):
        got = [tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept")) for r in substring_dedup.dedup(make_docs(rows), window).collect()]
        assert sorted(got, key=str) == brute(rows, window)


def test_empty(make_docs):
    assert substring_dedup.dedup(make_docs([])).count() == 0
