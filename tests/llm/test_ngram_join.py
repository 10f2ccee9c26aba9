import random
import re
from collections import defaultdict

import numpy as np

from plumbline.llm import ngram_join, registry
from tests.llm.conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, size=5):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                held[x].append(i)
    seen = set()
    for group in held.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    o = len(sets[i] & sets[j])
                    if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                        a, b = find(rows[i][0]), find(rows[j][0])
                        parent[max(a, b)] = min(a, b)
    return sorted(((d, len(s), d if d is None or not s else find(d)) for (d, _), s in zip(rows, sets)), key=str)


def test_query_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert sorted(map(tuple, registry.op2_ngram_join(spark, sf).collect()), key=str) == want
    assert sum(c != d for d, _, c in want) > 20


def test_chains_families_and_cells(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 8)
    rnd = random.Random(3)
    rows, d = [], 10
    for _ in range(12):
        w = [str(rnd.randrange(500)) for _ in range(rnd.randrange(20, 120))]
        for _ in range(rnd.randrange(1, 40)):  # a walk whose ends are far apart
            w = list(w)
            w[rnd.randrange(len(w))] = str(rnd.randrange(500))
            rows.append((d, " ".join(w).upper()))
            d += 1
    rows += ODD
    got = sorted((tuple(r) for r in ngram_join.join(make_docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_tree_finds_all_within_the_bound():
    rnd = np.random.default_rng(1)
    pts = rnd.integers(0, 6, (200, ngram_join.GROUPS)).astype(np.int32)
    sizes = pts.sum(1)
    tree = ngram_join.Tree(pts, sizes, 75)
    for i in range(0, 200, 7):
        bound = np.minimum(pts, pts[i]).sum(1)
        assert sorted(tree.search(pts[i], sizes[i])) == list(np.flatnonzero(bound >= ngram_join.needed(sizes, sizes[i], 75)))


def test_documents_of_several_texts_pool_their_links(make_docs):
    a, b, c = ("one two three four five six seven", "un deux trois quatre cinq six sept", "eins zwei drei vier fuenf sechs")
    rows = [(3, a), (7, a), (5, b), (7, b), (9, c), (9, None), (2, ""), (9, b + " huit"), (11, c), (None, a)]
    want = brute(rows)
    assert {x for _, _, x in want} == {3, 2, 9, None}
    assert sorted((tuple(r) for r in ngram_join.join(make_docs(rows)).collect()), key=str) == want
    spread = [(100 + i % 7, f"p{i} q{i} r{i} s{i} t{i} u{i}") for i in range(30)] + [(200 + i, f"p{i} q{i} r{i} s{i} t{i} u{i}") for i in range(30)]
    assert sorted((tuple(r) for r in ngram_join.join(make_docs(spread)).collect()), key=str) == brute(spread)


def test_empty(make_docs):
    assert ngram_join.join(make_docs([])).count() == 0


def test_visitors_of_a_hot_root_are_bounded(spark, make_docs, monkeypatch):
    """Texts share a template but are not its links: no task holds them all, and their own links are found."""
    monkeypatch.setattr(ngram_join, "CELL", 16)
    met, most = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    plain = ngram_join.Tree

    class Seen(plain):
        def __init__(self, points, sizes, percent):
            met.add(1)
            most.add(len(sizes) > 5 * 16)  # two sides of 16, dealt by hash
            super().__init__(points, sizes, percent)

    monkeypatch.setattr(ngram_join, "Tree", Seen)
    rnd = random.Random(5)
    template = [f"t{i}" for i in range(40)]
    near = [(i, " ".join([*template, f"e{i}"])) for i in range(40)]
    far = []
    for i in range(150):
        w = template + [f"v{i}.{rnd.randrange(10**6)}" for _ in range(12)]
        far.append((1000 + 2 * i, " ".join(w)))
        if i % 3 == 0:
            far.append((1001 + 2 * i, " ".join([*w[:-1], "z"])))
    rows = near + far
    got = sorted((tuple(r) for r in ngram_join.join(make_docs(rows)).collect()), key=str)
    assert got == brute(rows)
    assert met.value > 10 and most.value == 0
