"""Every catalogue query against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from colmeta.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    return v.strftime("%F %T.%f") if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(tuple(_plain(r[n]) for n in names) for r in df.collect()) == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())


def test_rows_only(spark, sf_dir):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_nearest_recall(spark, sf_dir):
    exact = {(r.query, r.id) for r in QUERIES["knn_topk"](spark, sf_dir).collect()}
    near = {(r.query, r.id) for r in QUERIES["knn_inverted_file"](spark, sf_dir).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_entry(spark):
    df = entry.entry(spark)
    assert {r.name: r.datatype for r in df.collect()}["o_orderdate"] == "date"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark, sf_dir):
    def plan(name):
        return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

    assert "WindowGroupLimit" in plan("type_profile_sampled")
    assert "WindowGroupLimit" in plan("knn_topk")
    for name in ("type_profile_orders", "merge_overwrite", "term_summary", "tableschema_fields", "change_groups", "knn_topk"):
        assert "Python" not in plan(name) or name == "term_summary"
        assert "Cartesian" not in plan(name)
    assert "Exchange hashpartitioning" not in plan("type_profile_orders")
    typed = QUERIES["type_profile_orders"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    texts = typed.split("transform(")[1].split("lambdafunction")[0]
    assert "o_orderstatus" in texts
    assert "o_orderpriority" in texts
    assert "o_totalprice" not in texts
    assert "o_orderdate" not in texts
