"""Every registered query that SQL can express, against DuckDB on the smallest tables; plans of some."""

import decimal

import duckdb
import pytest

from tessera.plans import blocktables, catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


QUERIES, ORACLES = catalog.QUERIES | blocktables.QUERIES, catalog.ORACLES | blocktables.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [list(rel.columns).index(c) for c in columns]
    wanted = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    found = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert found == wanted


@pytest.mark.parametrize("name", ["node_merge", "edge_merge", "coverage_cascade", "mention_stats"])
def test_plans_read_few_columns(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert "n_chars" not in plan and "lang" not in plan


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rouge_l", "rouge_w", "html_anchor_text", "rouge_bootstrap"])
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
