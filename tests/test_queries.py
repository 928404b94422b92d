"""Every registered query of the rest of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from meridian.plans.catalog import ORACLE_SQL, QUERIES

from .conftest import SF

def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert names == sorted(columns)
    order = [columns.index(n) for n in names]
    key = lambda r: [(v is None, str(v)) for v in r]
    right = sorted(([_plain(r[i]) for i in order] for r in want.fetchall()), key=key)
    assert sorted(([_plain(r[n]) for n in names] for r in df.collect()), key=key) == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_sane_values(spark, name):
    """test_brute.py and test_operators.py hold what these are made of against plain versions."""
    got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    assert got
    for r in got:
        assert all(v is None or not isinstance(v, float) or math.isfinite(v) for v in r.values())
        assert all(0 <= r[k] <= 1 for k in ("auroc", "brier", "hit_at_k", "mrr", "best", "recall") if k in r)
