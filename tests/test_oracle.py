"""Every registered query against its DuckDB oracle."""

import pytest

from conftest import SF_SMALL
from oracle_util import canon, duck

from __spark_entry__ import oracle_sql, queries

SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows, scols = canon([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(SQL[name])
    drows, dcols = canon(res.fetchall(), [d[0] for d in res.description])
    assert scols == dcols
    assert len(srows) == len(drows)
    assert srows == drows
