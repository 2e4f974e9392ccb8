"""Every query that has SQL gives the rows that DuckDB gives; the others give rows."""

import math

import duckdb
import pytest

from aerospan import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    try:
        return repr(round(float(v), 9) + 0.0)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert ours
    if name in catalogue.oracle_sql():
        cur = con.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall()) == ours
