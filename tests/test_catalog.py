"""Every query with a DuckDB twin gives the twin's rows on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from pagemill import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    return c


def _same(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    ours = Counter(tuple(_same(r[c]) for c in columns) for r in df.collect())
    rel = duck.execute(catalog.oracle_sql()[name])
    at = [x[0] for x in rel.description]
    assert sorted(at) == columns
    assert ours == Counter(tuple(_same(r[at.index(c)]) for c in columns) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_twin(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0
