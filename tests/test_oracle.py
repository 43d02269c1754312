"""Every registered query with SQL gives the rows that DuckDB gives."""

import datetime
import math
import os

import duckdb
import pytest

from boxspark.jobs import registry

SF = "/root/testdata/sf0.001"
TABLES = "lineitem orders supplier part events documents embeddings pages".split()


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else int(v) if v == int(v) else round(v, 6)
        return v.isoformat() if isinstance(v, datetime.datetime) else int(v) if isinstance(v, bool) else v

    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(registry.oracle_sql()[name])
    assert got == canonical([c[0] for c in cur.description], cur.fetchall())
