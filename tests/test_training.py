import pytest

from lodestar.operators import evaluation, measurement, sampling


def entries(spark, n, verified=True, split=None, stratum="s"):
    rows = [(f"{stratum}{i}", stratum, verified, split) for i in range(n)]
    return spark.createDataFrame(rows, "eval_id string, stratum string, verified boolean, split string")


@pytest.mark.parametrize("n, test", [(40, 12), (20, 6), (1, 0), (5, 2), (15, 4)])
def test_share_is_rounded_half_to_even(spark, n, test):
    out = sampling.assign_splits(entries(spark, n), ["stratum"])
    assert out.where("split = 'test'").count() == test


def test_split_is_frozen_and_free_of_order(spark):
    e = entries(spark, 60)
    first = sampling.assign_splits(e, ["stratum"])
    again = sampling.assign_splits(e.orderBy("eval_id", ascending=False), ["stratum"])
    assert sorted(first.collect()) == sorted(again.collect())
    grown = sampling.assign_splits(first.unionByName(entries(spark, 40, stratum="s1").withColumn("stratum", sampling.F.lit("s"))), ["stratum"])
    assert grown.where("split = 'test'").count() == 30
    assert first.where("split = 'test'").select("eval_id").subtract(grown.where("split = 'test'").select("eval_id")).count() == 0


def test_unverified_go_to_dev_and_bad_values_fail(spark):
    assert sampling.assign_splits(entries(spark, 10, verified=False), ["stratum"]).where("split = 'test'").count() == 0
    with pytest.raises(Exception, match="no such split"):
        sampling.assign_splits(entries(spark, 2, split="train"), ["stratum"]).collect()


def test_negatives(spark):
    hits = [("p", "good"), ("twin", "GOOD "), ("blank", " "), ("a", "Alpha"), ("a2", "alpha"), ("b", "beta"), ("c", "gamma"), ("k", "known")]
    ranked = spark.createDataFrame([(1, i, t, r) for r, (i, t) in enumerate(hits, 1)], "query_id int, chunk_id string, text string, rank int")
    good = spark.createDataFrame([(1, "p", "good")], "query_id int, chunk_id string, text string")
    known = spark.createDataFrame([(1, "Known")], "query_id int, text string")
    out = sampling.negatives(ranked, good, n=2, skip_top=1, also_exclude=known).orderBy("nth").collect()
    assert [r["chunk_id"] for r in out] == ["b", "c"]


def test_contamination(spark):
    q = spark.createDataFrame([(1, "what is net income of the bank"), (2, "net income of the bank is what"), (3, "!!"), (4, "else entirely")], "query_id int, text string")
    held = spark.createDataFrame([("What is the net income of the bank?",), ("?",)], "text string")
    assert {r["query_id"]: r["contaminated"] for r in sampling.contaminated(q, held).collect()} == {1: True, 2: True, 3: True, 4: False}
    with pytest.raises(ValueError, match="2 held-out"):
        sampling.require_no_leak(q.where("query_id < 3"), held)


def test_query_split_keeps_queries_whole(spark):
    rows = spark.createDataFrame([(f"q{i % 30}", i) for i in range(90)], "query string, i int")
    out = sampling.split_queries(rows)
    assert out.count() == 90 and out.where("split = 'val'").select("query").distinct().count() == 3
    assert out.groupBy("query").agg({"split": "max"}).count() == 30 == out.select("query", "split").distinct().count()


@pytest.mark.parametrize("one, two, verdict", [("ab", "ab", "identical"), ("ab", "ba", "tied"), ("ac", "ab", "tied"), ("xa", "ay", "different")])
def test_list_verdicts(spark, one, two, verdict):
    score = {"a": 0.5, "b": 0.5, "c": 0.5, "x": 0.9, "y": 0.1}
    lists = [spark.createDataFrame([(1, c, i, score[c]) for i, c in enumerate(ids, 1)], "query_id int, chunk_id string, rank int, score double") for ids in (one, two)]
    assert measurement.list_verdicts(*lists).first()["verdict"] == verdict


@pytest.mark.parametrize("n, share, want", [(5, 0.5, 2), (101, 0.95, 96), (1, 0.95, 1), (4, 0.5, 2)])
def test_nearest_rank(spark, n, share, want):
    df = spark.createDataFrame([(float(i),) for i in range(1, n + 1)], "v double")
    assert measurement.percentiles(df, (share,), value="v").first()["value"] == want


def test_parity(spark):
    a = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "kind string, id int")
    b = spark.createDataFrame([("t", 1), ("t", 4)], "kind string, id int")
    assert [tuple(r) for r in measurement.count_problems(a, b, "kind").collect()] == [("u", 1, 0)]
    assert sorted(tuple(r) for r in measurement.coverage_problems(a, b, "id").collect()) == [("one", 2), ("one", 3), ("two", 4)]


def test_routing_summary_without_structured(spark):
    df = spark.createDataFrame([("semantic", "semantic")], "expected_route string, route string")
    row = evaluation.routing_summary(df).first()
    assert row["accuracy"] == 1 and row["structured_precision"] is None
