import duckdb
import pytest

from plumbline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(registry.ORACLES[name])
    cols = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.fetchall())
