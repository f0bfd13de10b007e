"""Every registered query that has an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pytest

from siftwork.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(data, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(str(plain(r[k])) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        columns = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(got, df.columns) == rows(cur.fetchall(), columns)
    else:
        assert df.columns
