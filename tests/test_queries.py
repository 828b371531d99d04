"""Every query against its SQL on the smallest driver tables."""

import duckdb
import pytest

from jointedge.plans import oracle
from jointedge.plans.queries import QUERIES
from jointedge.sources.tables import NAMES

NAMED = sorted(QUERIES)


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and v else "0" if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in [*NAMES, "documents"]:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(oracle.SQL) == set(QUERIES)


@pytest.mark.parametrize("name", NAMED)
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM ({oracle.SQL[name]})").fetchall()
    got = df.select(*columns).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)
