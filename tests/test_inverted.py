"""The inverted file against the exact form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colmeta.operators import inverted, match


def _pairs(df):
    return {(r["query"], r["id"]) for r in df.collect()}


def _terms(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>").repartition(4)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    return rng.normal(0, 1, (40, 24))[rng.integers(0, 40, 4000)] + rng.normal(0, 0.2, (4000, 24))


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("scale", [0.001, 1000.0])
def test_recall_at_any_scale(spark, clustered, metric, scale):
    terms = _terms(spark, clustered * scale)
    asked = terms.where("id % 100 = 0").withColumnRenamed("id", "query")
    index = inverted.inverted_file(terms, metric=metric)
    exact = match.nearest(asked, terms, metric=metric, exclude_same_id=True)
    near = inverted.near_by_lists(asked, index, exclude_same_id=True)
    assert len(_pairs(exact)) == len(_pairs(near)) == 160
    assert len(_pairs(exact) & _pairs(near)) >= 144
    assert 1 <= index.probes < len(index.centres) / 4
    far = {(r["query"], r["id"]): r.distance for r in exact.collect()}
    assert all(abs(far[r["query"], r["id"]] - r.distance) <= 1e-6 * max(1.0, scale) ** 2 for r in near.collect() if (r["query"], r["id"]) in far)


def test_vectors_without_clusters_get_more_probes(spark):
    terms = _terms(spark, np.random.default_rng(1).normal(0, 1, (1500, 32)))
    asked = terms.where("id % 30 = 0").withColumnRenamed("id", "query")
    index = inverted.inverted_file(terms)
    exact, near = _pairs(match.nearest(asked, terms, exclude_same_id=True)), _pairs(inverted.near_by_lists(asked, index, exclude_same_id=True))
    assert index.probes > 5
    assert len(exact & near) >= 0.9 * len(exact)
    assert _pairs(inverted.near_by_lists(asked, index, probes=len(index.centres), exclude_same_id=True)) == exact


def test_every_term_is_in_one_list_and_hot_lists_are_cut(spark, clustered):
    x = clustered.copy()
    x[:1500] = x[0]  # a third of all terms are one vector
    index = inverted.inverted_file(_terms(spark, x), path=None)
    ids = [i for r in index.blocks.collect() for i in np.frombuffer(r.ids, np.int64)]
    assert sorted(ids) == list(range(4000))
    near = inverted.near_by_lists(_terms(spark, x[:1]).withColumnRenamed("id", "query"), index).collect()
    assert [(r.id, r.distance) for r in sorted(near, key=lambda r: r["rank"])] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_a_bounded_sample_fits_the_centres(spark, clustered):
    terms = _terms(spark, clustered)
    index = inverted.inverted_file(terms, sample=200, lists=20)
    assert len(index.centres) <= 20
    assert index.blocks.agg(F.sum(F.octet_length("ids") / 8)).first()[0] == 4000


def test_short_answers_go_the_exact_way(spark):
    terms = _terms(spark, np.vstack([np.eye(6) * 100, np.ones((1, 6))]))
    asked = spark.createDataFrame([(9, [100.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "query long, vector array<double>")
    index = inverted.inverted_file(terms, lists=7)
    assert _pairs(inverted.near_by_lists(asked, index, probes=1)) == _pairs(match.nearest(asked, terms))


def test_odd_vectors(spark):
    terms = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, None), (4, [None, 1.0]), (5, [1.0]), (6, []), (7, [float("nan"), 0.0]), (None, [0.0, 1.0])], "id long, vector array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (8, None), (9, [1.0, 2.0, 3.0])], "query long, vector array<float>")
    assert _pairs(inverted.near_by_lists(asked, inverted.inverted_file(terms))) == {(1, 1), (1, 2)}
    assert inverted.near_by_lists(asked.where("false"), inverted.inverted_file(terms)).count() == 0
    assert inverted.near_by_lists(asked, inverted.inverted_file(terms.where("false"))).count() == 0
    with pytest.raises(ValueError, match="neither|not l2sq"):
        inverted.inverted_file(terms, metric="dot")
