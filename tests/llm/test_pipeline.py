from collections import defaultdict

import corpus_pipeline as P
from tests.llm.conftest import ODD
from tests.llm.test_ngram_join import brute as near_brute
from tests.llm.test_packing import check
from tests.llm.test_substring_dedup import brute as passage_brute


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = P.language(spark, docs, sf).cache()
    assert one.schema.names == docs.schema.names
    kept = {r.doc_id for r in one.collect()}
    lost = [r for r in docs.collect() if r.doc_id not in kept]
    assert len(lost) < 0.02 * docs.count()
    two = P.near_duplicates(spark, one, sf).cache()
    pairs = [(r.doc_id, r.text) for r in one.collect()]
    want = {d for d, _, c in near_brute(pairs) if d == c}
    assert {r.doc_id for r in two.collect()} == want and two.count() == len(want)
    three = P.passages(spark, two, sf).cache()
    before = {r.doc_id: r for r in two.collect()}
    got = {r.doc_id: r for r in three.collect()}
    for d, n, gone, text in passage_brute([(r.doc_id, r.text) for r in before.values()], 50):
        if n and gone == n:
            assert d not in got
        else:
            assert got[d].text == (text if gone else before[d].text) and got[d].n_chars == len(got[d].text)
            assert got[d][2:4] == before[d][2:4]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = {d: [*t.encode(r.text, add_special_tokens=False).ids, 2] for d, r in got.items()}
    last = P.packed(spark, three, sf)
    check(last.collect(), ids, 4096)
    total = defaultdict(int)
    for r in P.run(spark, sf).collect():
        total[r.doc_id] += r.length
    assert total == {d: len(x) for d, x in ids.items()}


def test_odd_rows_and_empty_table(make_docs, spark):
    docs = make_docs([*ODD, *[(100 + i, "the quick brown fox jumps over a lazy dog " * (i + 1)) for i in range(8)], (50, None, None)])
    for table in (docs, make_docs([])):
        for _, step in P.STAGES:
            nxt = step(spark, table, "")
            if step is not P.packed:
                assert nxt.schema.names == docs.schema.names
            table = nxt
        table.count()


def test_columns_that_clash_are_carried_through(spark):
    long = " ".join(f"w{i}" for i in range(60))
    own = lambda x: " ".join(f"{x} the{i} house" for i in range(15))
    rows = [(1, f"{own('a')} {long}", "en"), (2, f"{long} {own('and')}", "en"), (3, "the quick brown fox and the lazy dog are here", "en"), (3, "the quick brown fox and the lazy dog are here", "en")]
    names = ["score", "lang_pred", "told", "kept", "found", "_k", "_m", "_n", "_gone", "_kept", "kept_id", "k", "m", "comp", "block", "a.b"]
    docs = spark.createDataFrame([(*r, "s", len(r[1]), *(f"{c}{r[0]}" for c in names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    table = docs
    for _, step in P.STAGES[:3]:
        table = step(spark, table, "")
        assert table.schema.names == docs.schema.names
        got = table.collect()
        assert {r.doc_id for r in got} == {1, 2, 3} and all(r[5:] == tuple(f"{c}{r.doc_id}" for c in names) for r in got)
    assert {r.doc_id: len(r.text.split()) for r in got}[2] == 45
    assert P.packed(spark, table, "").count() >= 3
