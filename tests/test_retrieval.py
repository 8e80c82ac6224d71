import math

import pytest

from lodestar.operators import metrics, retrieval


def ranked(spark, **lists):
    rows = [(1, r, c, i) for r, ids in lists.items() for i, c in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "query_id int, retriever string, chunk_id string, rank int")


def test_fusion_adds_reciprocal_ranks(spark):
    out = {r["chunk_id"]: r["score"] for r in retrieval.fuse(ranked(spark, a=["x", "y"], b=["y", "x"]), {"a": 1, "b": 1}).collect()}
    assert out == {"x": pytest.approx(1 / 61 + 1 / 62, abs=1e-9), "y": pytest.approx(1 / 61 + 1 / 62, abs=1e-9)}


def test_fusion_prefers_overlap_and_breaks_ties_by_id(spark):
    out = retrieval.fuse(ranked(spark, a=["x", "m"], b=["y", "m"]), {"a": 1, "b": 1}).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["m", "x", "y"]


def test_fusion_weights(spark):
    out = retrieval.fuse(ranked(spark, a=["x"], b=["y"]), {"a": 1, "b": 3}).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["y", "x"] and out[0]["score"] == pytest.approx(3 * out[1]["score"], abs=1e-8)


def test_fusion_needs_a_weight_for_each_retriever(spark):
    with pytest.raises(Exception, match="no weight for retriever b"):
        retrieval.fuse(ranked(spark, a=["x"], b=["y"]), {"a": 1}).collect()


@pytest.mark.parametrize("weight, depth", [(0.25, 184), (1.0, 1), (0.0, 0), (0.5, 62)])
def test_dense_entry_depth(spark, weight, depth):
    from pyspark.sql import functions as F

    assert spark.range(1).select(retrieval.dense_entry_depth(F.lit(weight)).alias("d")).first()["d"] == depth


@pytest.mark.parametrize("n, inside", [(183, False), (185, True)])
def test_dense_hit_enters_a_full_pool_beyond_the_depth(spark, n, inside):
    lex = ranked(spark, lexical=[f"l{i:04}" for i in range(n)]).select("query_id", "chunk_id", "rank")
    dense = ranked(spark, dense=["zz"]).select("query_id", "chunk_id", "rank")
    pool = {r["chunk_id"] for r in retrieval.hybrid(lex, dense, n, candidates=n).collect()}
    assert ("zz" in pool) == inside


def scores(spark, ids, relevant, cuts=(1, 3)):
    labels = spark.createDataFrame([(1, r) for r in relevant], "query_id int, chunk_id string")
    return metrics.per_query(ranked(spark, a=ids), labels, spark.createDataFrame([("a",)], "retriever string"), cuts).first()


def test_ndcg_at_rank_two(spark):
    assert scores(spark, ["x", "r"], ["r"])["ndcg_at_3"] == pytest.approx(1 / math.log2(3))


def test_average_precision(spark):
    assert scores(spark, ["a", "x", "b"], ["a", "b"])["map"] == pytest.approx((1 + 2 / 3) / 2)
    assert scores(spark, ["a"], ["a", "b"])["map"] == 0.5


def test_more_labels_than_the_cut_can_reach_one(spark):
    assert scores(spark, ["a"], ["a", "b"])["ndcg_at_1"] == 1 and scores(spark, ["a"], ["a", "b"])["recall_at_1"] == 0.5


def test_a_miss_counts_zero(spark):
    row = scores(spark, ["x"], ["r"])
    assert row["mrr"] == row["map"] == row["recall_at_3"] == 0 and row["first_rank"] is None


def test_nearest_excludes_filters_and_orders_ties(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0], i % 2) for i in range(6)], "id long, embedding array<float>, label int")
    out = retrieval.nearest(v.where("id = 4"), v, 2, {"label": 0}, exclude_self=True).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == [0, 2]


def test_nearest_of_nothing(spark):
    v = spark.createDataFrame([], "id long, embedding array<float>")
    assert retrieval.nearest(v, v, 3).count() == 0


def test_rerank_keeps_all_without_k(spark):
    from pyspark.sql import functions as F

    c = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.4, 2)], "query_id int, chunk_id string, score double, rank int")
    out = retrieval.rerank(c, lambda df: df.withColumn("new_score", -F.col("retrieval_score")), 0).orderBy("rank").collect()
    assert [(r["chunk_id"], r["retrieval_score"]) for r in out] == [("b", 0.4), ("a", 0.5)]


def test_stemmer():
    from lodestar.operators.stemming import tokens

    assert tokens("The bank's relational ponies hopping, agreed & sized") == ["bank", "relat", "poni", "hop", "agre", "size"]


@pytest.mark.parametrize("cells", [(7, 3), (50_000, 5_000)])
def test_many_queries_are_dealt_with_the_vectors(spark, monkeypatch, cells):
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.round(rng.standard_normal((60, 4)), 1)  # with ties
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")
    asked = rows.where("id % 3 = 0").union(spark.createDataFrame([(99, None)], rows.schema))
    listed = lambda df: sorted(map(tuple, df.collect()))
    want = [listed(retrieval.nearest(asked, rows, 5, exclude_self=x)) for x in (False, True)]
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 10)
    monkeypatch.setattr(retrieval, "CELL_ROWS", cells[0])
    monkeypatch.setattr(retrieval, "CELL_QUERIES", cells[1])
    assert [listed(retrieval.nearest(asked, rows, 5, exclude_self=x)) for x in (False, True)] == want and len(want[0]) == 100
    assert retrieval.nearest(asked.limit(0), rows, 5).count() == 0


@pytest.fixture
def unit_vectors():
    import numpy as np

    v = np.random.default_rng(3).standard_normal((3_000, 8)).astype(np.float32)
    return np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 2)  # with ties


@pytest.mark.parametrize("exclude_self", [False, True])
def test_scores_of_many_queries_are_worked_out_in_blocks(unit_vectors, exclude_self):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    v = unit_vectors.astype(np.float64)
    ids = np.arange(len(v))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(unit_vectors))], ["id", "embedding"])
    held = type("Held", (), {"value": (ids, v)})
    tracemalloc.start()
    (out,) = retrieval.nearest_in_batches(held, 5, exclude_self, 6)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(v) ** 2 * 0.8  # less than all scores at once
    scores = np.round(v @ v.T, 6)
    if exclude_self:
        np.fill_diagonal(scores, -np.inf)
    found = {}
    for q, c, s in zip(*(c.to_pylist() for c in out.columns), strict=True):
        found.setdefault(q, []).append((-s, c))
    assert all(sorted(found[q]) == sorted(zip(-scores[q], ids, strict=True))[:5] for q in range(0, len(v), 50)) and len(found) == len(v)


@pytest.mark.parametrize("most", [10, 64_000_000])
def test_lsh_equals_all_pairs_that_share_a_code_and_shuffles_none(spark, monkeypatch, unit_vectors, most):
    import numpy as np

    from lodestar.operators import lsh

    monkeypatch.setattr(retrieval, "QUERY_BYTES", most)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit_vectors[:400])], "id long, embedding array<float>")
    found = lsh.nearest_approximately(rows.where("id % 20 = 0"), rows, 4, dims=8, tables=3, bits=3)
    v = unit_vectors[:400].astype(np.float64)
    codes = lsh.sign_codes(8, 3, 3)(v)
    want = []
    for q in range(0, 400, 20):
        near = np.flatnonzero((codes == codes[q]).any(axis=1))
        assert len(near) < 400
        best = sorted((-round(float(v[q] @ v[c]), 6), int(c)) for c in near)[:4]
        want += [(q, c, -s, i) for i, (s, c) in enumerate(best, 1)]
    assert sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in found.collect()) == sorted((q, c, pytest.approx(s, abs=1e-6), i) for q, c, s, i in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_tasks_of_bm25_hold_a_bounded_number_of_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(retrieval, "TASK_PAIRS", 600)
    corpus = spark.range(1000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    asked = spark.createDataFrame([(1, "w"), (2, "w 7"), (3, "nothing")], "query_id long, text string")
    scored = retrieval.bm25_scores(asked, corpus)
    tasks = [r["count"] for r in scored.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2000 and max(tasks) <= 600
    best = retrieval.bm25(asked, corpus, 1).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in best} == {(1, 0), (2, 7)}
