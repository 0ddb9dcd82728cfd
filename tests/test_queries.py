"""Every query with SQL against DuckDB; the others must run and keep their promises."""

from collections import Counter

import duckdb
import pytest

from augury.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events".split()


def text(v):
    if isinstance(v, float):
        return "0.0" if v == 0 else repr(v)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    found = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    want = Counter(tuple(text(v) for _, v in sorted(zip(names, r, strict=True), key=lambda x: x[0])) for r in found.fetchall())
    got = Counter(tuple(text(v) for v in r) for r in df.select(*[f"`{c}`" for c in sorted(names)]).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    for c in ("calibrated", "predicted_prob"):
        if c in df.columns:
            assert all(0 <= r[c] <= 1 for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
