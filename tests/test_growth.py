"""What grows with the tables stays bounded: blocks, repeats, bounds of distances, batches of requests."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colmeta.functions import vectors
from colmeta.operators import match


def _table(spark, x, key):
    return spark.createDataFrame([(i, r) for i, r in enumerate(np.asarray(x, float).tolist())], f"{key} long, vector array<double>").repartition(3)


def _brute(q, t, k, metric, exclude):
    out = set()
    for i, a in enumerate(q):
        if metric == "l2sq":
            d = ((a - t) ** 2).sum(axis=1)
        else:
            length = np.sqrt((a * a).sum()) * np.sqrt((t * t).sum(axis=1))
            d = 1 - np.where(length > 0, (a * t).sum(axis=1) / np.where(length > 0, length, 1), 0)
        near = [j for j in np.lexsort((np.arange(len(t)), d.round(12))).tolist() if not (exclude and i == j)][:k]
        out |= {(i, j, n + 1) for n, j in enumerate(near)}
    return out


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_repeated_vectors_meet_once(spark, metric, monkeypatch):
    x = np.random.default_rng(3).integers(-4, 5, (40, 6))[np.random.default_rng(4).integers(0, 40, 900)]
    seen, met = [], match.met
    monkeypatch.setattr(match, "met", lambda pairs, *a: seen.append(pairs) or met(pairs, *a))
    q, t = _table(spark, x, "query"), _table(spark, x, "id")
    for exclude in (False, True):
        got = match.nearest(q, t, 4, metric, exclude_same_id=exclude)
        assert {(r["query"], r["id"], r["rank"]) for r in got.collect()} == _brute(x, x, 4, metric, exclude)
    vectors_sent = seen[0].agg(F.sum(F.octet_length("q_xs") / 8 / F.col("dim"))).first()[0]
    assert vectors_sent <= 40 * 4  # a copy for each of four parts of terms at most


def test_an_encoded_vector_is_made_once(spark):
    df = spark.createDataFrame([(1, "soil depth"), (2, None)], "query long, text string").select("query", vectors.hashed_vector(F.col("text")).alias("vector"))
    plan = match._fine(df, "query")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_bounds_lose_no_neighbour(spark, metric, monkeypatch):
    monkeypatch.setattr(match, "BOUNDED", 100)
    monkeypatch.setattr(match, "CELL", 150)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (700, 40))
    x[100:300] = x[7]  # a large group of copies
    x[300:310] = 0
    q, t = _table(spark, x, "query").where("query % 20 = 7 or query between 298 and 312"), _table(spark, x, "id")
    for exclude in (False, True):
        got = match.nearest_by_expression(q, t, 4, metric, exclude_same_id=exclude)
        asked = {r["query"] for r in q.collect()}
        assert {(r["query"], r["id"], r["rank"]) for r in got.collect()} == {p for p in _brute(x, x, 4, metric, exclude) if p[0] in asked}


def test_expression_form_is_compiled_and_sorts_few_pairs(spark):
    x = np.random.default_rng(6).normal(0, 1, (6000, 4))
    got = match.nearest_by_expression(_table(spark, x[:50], "query"), _table(spark, x, "id"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.split("Join Inner")[0]
    assert "bound#" in plan


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_cells_of_pairs_have_a_partition_each_and_cost_a_product(spark, metric, monkeypatch):
    monkeypatch.setattr(match, "BOUNDED", 100)
    monkeypatch.setattr(match, "CELL", 50)
    monkeypatch.setattr(match, "ASKED", 20)
    x = np.random.default_rng(8).normal(0, 1, (600, 5))
    got = match.nearest_by_expression(_table(spark, x[:60], "query"), _table(spark, x, "id"), 4, metric)
    plan = got._jdf.queryExecution()
    assert set(re.findall(r"hashpartitioning\(q_part#\d+, t_part#\d+, dim#\d+, (\d+)\)", plan.executedPlan().toString())) == {"36"}
    (condition,) = re.findall(r"Join Inner, (.*)", plan.optimizedPlan().toString())
    assert "least#" in condition
    for i in range(5):  # Spark works out what occurs twice for every pair, before any test
        assert len(re.findall(rf"\bq{i}#", condition)) == 1
    assert {(r["query"], r["id"], r["rank"]) for r in got.collect()} == {p for p in _brute(x, x, 4, metric, False) if p[0] < 60}


def test_bounds_keep_vectors_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(match, "BOUNDED", 100)
    x = np.random.default_rng(9).normal(0, 1, (400, 3))
    x[50:60] *= 1e200  # their squares are beyond doubles
    x[60:70] *= 1e-200
    x[70:80] *= 1e100
    x[390] = x[50]
    q, t = _table(spark, x, "query").where("query between 45 and 85"), _table(spark, x, "id")
    got = {(r["query"], r["id"], r["rank"]) for r in match.nearest_by_expression(q, t).collect()}
    with np.errstate(over="ignore"):
        assert got == {p for p in _brute(x, x, 4, "l2sq", False) if 45 <= p[0] <= 85}


def test_a_batch_of_pairs_is_few_bytes(spark, monkeypatch):
    seen, met = [], match.met
    monkeypatch.setattr(match, "met", lambda pairs, *a: seen.append(pairs) or met(pairs, *a))
    x = np.random.default_rng(10).integers(-9, 10, (1500, 64))
    got = match.nearest(_table(spark, x, "query"), _table(spark, x, "id"), stripes=1)
    most = seen[0].agg(F.max(F.octet_length("q_xs") + F.octet_length("xs"))).first()[0]
    assert 100 * most <= 20 << 20  # a worker gets pairs by a hundred
    assert got.count() == 1500 * 4


def test_copies_of_blocks_are_not_broadcast(spark, monkeypatch):
    seen, met = [], match.met
    monkeypatch.setattr(match, "met", lambda pairs, *a: seen.append(pairs) or met(pairs, *a))
    x = np.random.default_rng(11).integers(-9, 10, (1500, 8))
    got = match.nearest(_table(spark, x, "query").where("query % 100 = 0"), _table(spark, x, "id"), stripes=64)
    assert got.count() == 15 * 4
    seen[0].collect()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan  # the driver would hold a copy of the queries for each part of terms


def test_hits_that_are_read_three_times_are_made_once(spark, sf_dir):
    from colmeta.plans import queries

    plan = queries.headers_without_match(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3
    assert "BatchEvalPython" not in plan


def test_training_uses_up_its_rows():
    from colmeta.llm import toxicity

    rows = toxicity._features([b"good words here", b"bad words there"] * 20)
    toxicity._train(rows, np.array([0, 1] * 20))
    assert rows == []
