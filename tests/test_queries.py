"""Every registered query against its SQL, over the whole smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows
    if name in entry_point.oracle_sql():
        found = duck.execute(entry_point.oracle_sql()[name])
        named = [d[0] for d in found.description]
        assert sorted(named) == columns
        want = [tuple(r[named.index(c)] for c in columns) for r in found.fetchall()]
        assert in_order(rows) == in_order(want)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
