"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from lotscope.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return str(v)[:10] if hasattr(v, "isoformat") and str(v).endswith("00:00:00") else repr(v) if not hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.SQL:
        assert got is not None
        return
    r = duck.execute(registry.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
