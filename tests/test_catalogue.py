import duckdb
import pytest

from heddle.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(records):
    return sorted(tuple(str(x) for x in r) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_its_oracle(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == rows([r[names.index(c)] for c in columns] for r in found.fetchall())
