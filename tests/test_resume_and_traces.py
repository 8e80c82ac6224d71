import time

import pytest
from pyspark.sql import functions as F
from test_engine import chunk

from lodestar import schemas
from lodestar.api import Engine
from lodestar.operators import resume
from lodestar.operators.enrich import indexable
from lodestar.operators.resume import bloom, new_rows
from lodestar.operators.tracing import Metrics, Trace


@pytest.mark.parametrize("most", [resume.MOST_BITS, 1024])  # a filter that is too full only joins more
def test_new_rows_are_those_of_an_anti_join(spark, monkeypatch, most):
    monkeypatch.setattr(resume, "MOST_BITS", most)
    rows = spark.range(5000).select(F.when(F.col("id") % 500 != 499, F.col("id").cast("string")).alias("id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = rows.union(rows.where("id = '4998'"))
    known = spark.range(0, 5000, 3).select(F.col("id").cast("string").alias("id")).union(spark.createDataFrame([(None,), ("7",)], "id string"))
    found = new_rows(rows, known, "id")
    assert sorted(r["text"] for r in found.collect()) == sorted(r["text"] for r in rows.join(known, "id", "left_anti").collect())
    assert found.columns == rows.columns and new_rows(rows, known.limit(0), "id").count() == 5001 and new_rows(rows.limit(0), known, "id").count() == 0


def test_a_filter_has_all_its_ids_and_few_others(spark):
    known = spark.range(20_000)
    seen = bloom(known, "id")
    assert known.where(~seen.has("id")).count() == 0
    assert spark.range(20_000, 60_000).where(seen.has("id")).count() < 1200


def test_no_text_is_moved_for_known_rows(spark):
    rows = spark.range(1000).select("id", F.lit("long text").alias("text"))
    plan = new_rows(rows, spark.range(500), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert plan.count("BroadcastExchange") == 1 and "ArrowEvalPython" in plan


def test_a_short_run_takes_the_first_ids(spark):
    rows = spark.createDataFrame([(f"c{i}", "paragraph", "a text of more than twenty letters", None) for i in (5, 3, 9, 1)], "chunk_id string, chunk_type string, text string, enriched boolean")
    first = indexable(rows, most=2)
    assert [r["chunk_id"] for r in first.orderBy("chunk_id").collect()] == ["c1", "c3"]
    assert sorted(r["chunk_id"] for r in indexable(rows, done=first, most=5).collect()) == ["c5", "c9"]


@pytest.fixture()
def engine(spark):
    corpus = spark.createDataFrame([chunk(1, "deposits grew in oregon"), chunk(2, "loans fell")], schemas.CHUNK).withColumn("chunk_id", F.substring("chunk_id", 2, 9).cast("long"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    fact = spark.createDataFrame([("COLB", "Assets", 5e9, "USD", "FY", "instant", "1", "url", None, "2023-12-31", "f")], schemas.FACT)
    return Engine(corpus, vectors, fact, lambda q: q.select(F.col("query_id").alias("id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding")),
                  generate=lambda df: df.withColumn("answer", F.lit("They grew [1].")))


def test_a_request_tells_its_routes_and_times_without_another_action(spark, engine):
    asked = spark.createDataFrame([(1, "Total assets of Columbia in 2023?"), (2, "Why did deposits grow?"), (3, "And loans?")], "query_id long, question string")
    trace = Trace(spark)
    out = engine.ask(asked, trace=trace)
    with trace.span("answer"):
        assert len(out.collect()) == 3
    ran = len(trace.jobs())
    assert trace.counts() == {"route": {"structured": 1, "semantic": 2}, "search": {"hits": 4}, "answers": {"answered": 3, "structured": 1, "refused": 0}}
    spans = {s["span"]: s for s in trace.stages()}
    assert len(trace.jobs()) == ran and set(spans) == {"route", "search", "answer"}
    assert all(s["jobs"] > 0 and s["tasks"] > 0 and s["seconds"] > 0 for s in spans.values()) and spans["search"]["rows_read"] > 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None

    metrics = Metrics()
    metrics.add(trace, "ask")
    metrics.add(trace, "ask", "failed")
    text = metrics.text()
    assert 'lodestar_route_total{route="semantic"} 4' in text and 'lodestar_requests_total{endpoint="ask",status="failed"} 1' in text
    assert 'lodestar_request_latency_seconds_bucket{endpoint="ask",le="+Inf"} 2' in text and "lodestar_retrieval_latency_seconds_count 2" in text


def test_counts_of_what_did_not_run_are_none(spark):
    trace = Trace(spark)
    trace.watch(spark.range(3), "never", n=F.count("*"))
    assert trace.counts() == {} and trace.stages() == []
    with pytest.raises(ValueError), trace.span("broken"):
        raise ValueError
    assert trace.spans["broken"] >= 0


def test_histograms_are_cumulative():
    metrics = Metrics("x")
    for s in (0.001, 0.2, 0.2, 60):
        metrics.time("t", s, a='q"')
    lines = metrics.text().splitlines()
    assert lines[0] == 'x_t_bucket{a="q\\"",le="0.005"} 1' and 'x_t_bucket{a="q\\"",le="0.25"} 3' in lines and 'x_t_bucket{a="q\\"",le="10"} 3' in lines
    assert lines[-2:] == ['x_t_sum{a="q\\""} 60.401', 'x_t_count{a="q\\""} 4']


def test_an_engine_says_whether_it_can_answer(spark, engine):
    assert engine.health() == {"status": "ok", "spark": True}
    assert engine.ready({"model": "m"}, {"model": "m"}) == {"ready": True, "tables": {}, "identity": []}
    engine.facts = engine.facts.limit(0)
    engine.corpus = engine.corpus.withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    state = engine.ready({"model": "m"}, {"model": "n"})
    assert not state["ready"] and state["tables"]["facts"] == "empty" and "lost" in state["tables"]["corpus"] and len(state["identity"]) == 1


def test_spans_within_spans_have_their_own_jobs(spark):
    trace = Trace(spark)
    with trace.span("outer"):
        with trace.span("inner"):
            spark.range(5).count()
        spark.range(5).count()
    time.sleep(0.2)
    assert sorted({s for s, _ in trace.jobs()}) == ["inner", "outer"]
