"""Every query of the catalogue against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from glyphmill.plans import catalogue as K

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def by_name(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(K.SQL))
def test_same_rows(spark, con, name):
    df = K.QUERIES[name](spark, SF)
    found = con.execute(K.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert by_name(map(tuple, df.collect()), df.columns) == by_name(found.fetchall(), columns)
