import os

import pytest
from oracle import assert_same

from lodestar import plans

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(plans.QUERIES[name](spark, DIR), plans.SQL[name], DIR)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, DIR).count() > 0


def test_lsh_finds_most_neighbours(spark):
    from lodestar.operators.measurement import ann_recall

    exact = plans.search.vectors(spark, DIR)
    exact = plans.search.retrieval.nearest(exact.where("id % 20 = 0"), exact, 10)
    recall = ann_recall(exact, plans.QUERIES["knn_lsh"](spark, DIR), 10).agg({"recall": "avg"}).first()[0]
    assert recall > 0.8


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_limit(spark):
    plan = plans.QUERIES["bm25_topk"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "n_chars" not in plan
