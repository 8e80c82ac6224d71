import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import encoding, evaluation, measurement
from lodestar.sources.files import index_count
from lodestar.streaming.ingest import newest, upsert_batch


def maker():
    prefix = encoding.QUERY_PREFIX

    def make():
        """Vectors of unit length that tell a text's length and whether the prefix stands before it."""

        def encode(texts):
            rows = [[len(t.removeprefix(prefix)) + 1.0, float(t.startswith(prefix)), 1.0] for t in texts]
            return np.array([np.array(r) / np.linalg.norm(r) for r in rows], np.float32).reshape(-1, 3)

        return encode

    def double():
        return lambda texts: 2 * make()(texts)

    return make, double


stub, twice = maker()  # workers get these by value


def test_prefix_stands_before_queries_only_and_order_stays(spark):
    rows = spark.createDataFrame([(i, "x" * (i * 7 % 11)) for i in range(40)] + [(None, None)], "id long, text string")
    for side, prefixed in ((encoding.passages, 0), (encoding.queries, 1)):
        out = {r["id"]: r["embedding"] for r in side(rows, stub, 3, id_col="id", batch=4).collect()}
        assert len(out) == 41
        for i, v in out.items():
            assert v[0] / v[2] == pytest.approx((0 if i is None else i * 7 % 11) + 1, rel=1e-5) and (v[1] > 0) == prefixed
    assert encoding.passages(rows.limit(0), stub, 3, id_col="id").collect() == []
    apart = measurement.sides_apart(encoding.queries(rows, stub, 3, id_col="id"), encoding.passages(rows, stub, 3, id_col="id")).first()
    assert apart["n"] == 40 and apart["max_cosine"] < 1
    assert not measurement.sides_apart(encoding.passages(rows, stub, 3, id_col="id"), encoding.passages(rows, stub, 3, id_col="id")).first()["ok"]


def test_contract(spark):
    encoding.require_contract(stub(), 3)
    with pytest.raises(ValueError, match="shape"):
        encoding.require_contract(stub(), 4)
    with pytest.raises(ValueError, match="norm"):
        encoding.require_contract(twice(), 3)
    encoding.require_unit_norm(np.empty((0, 3)), "none")
    rows = spark.createDataFrame([(1, "a")], "chunk_id long, text string")
    with pytest.raises(Exception, match="norm"):
        encoding.passages(rows, twice, 3).collect()


def test_backend_is_known():
    known = ("one", "two")
    assert encoding.resolve(None, known, "E", "one", {}) == "one" and encoding.resolve(None, known, "E", "one", {"E": "two"}) == "two"
    assert encoding.resolve("one", known, "E", "two", {"E": "two"}) == "one"
    with pytest.raises(ValueError):
        encoding.resolve("three", known, "E", "one", {})


def test_point_of_a_curve(spark):
    exact = spark.createDataFrame([(q, 10 * q + r, r) for q in range(4) for r in (1, 2)], "query_id long, chunk_id long, rank long")
    queries = exact.select("query_id").distinct()
    point = measurement.measure_point(lambda q: exact.join(q, "query_id"), queries, exact, 2, repeats=2)
    assert (point["recall"], point["n_exact"], point["deterministic"], len(point["ms"])) == (1.0, 4, True, 2)
    half = measurement.measure_point(lambda q: exact.join(q, "query_id").where("rank = 1"), queries, exact, 2, repeats=1)
    assert (half["recall"], half["recall_min"], half["n_exact"]) == (0.5, 0.5, 0)
    best, base = {"ef": 200, "recall": 0.995, "p95": 9.0}, {"ef": None, "recall": 0.9, "p95": 4.0}
    assert "is met" in measurement.justification(best, base) and "nearest" in measurement.justification(base, base)
    assert measurement.identity_problems({"profile": "a", "index": "i"}, {"profile": "a", "index": "j"}) == ["index: 'j' is served, 'i' was asked for"]


def test_arms_that_do_not_fit(spark):
    rows = [(a, i, "dev", r, q, 1, q + (x if r == "bm25" else 0)) for a, i, x in (("one", "i1", 0), ("two", "i2", 0)) for r in ("bm25", "dense") for q in (1, 2)]
    schema = "arm string, index string, split string, retriever string, query_id long, rank long, chunk_id long"
    assert evaluation.arm_problems(spark.createDataFrame(rows, schema)).collect() == []
    odd = rows + [("three", "i1", "dev", "bm25", 1, 1, 99)]
    found = {r["check"] for r in evaluation.arm_problems(spark.createDataFrame(odd, schema)).collect()}
    assert found == {"same index", "questions", "bm25 lists"}


def test_stream_versions(spark, tmp_path):
    path, rows = str(tmp_path / "index"), lambda *x: spark.createDataFrame(list(x), "chunk_id string, text string")
    assert index_count(spark, path) == 0
    with pytest.raises(ValueError):
        upsert_batch(path)(rows(("a", "1")), 3)
    upsert_batch(path)(rows(("a", "1"), ("b", "1")), 0)
    upsert_batch(path)(rows(("b", "2")), 1)
    upsert_batch(path)(rows(("b", "2")), 1)  # the batch runs again
    upsert_batch(path)(rows(("c", "3")), 0)  # a new checkpoint over the index
    assert {r["chunk_id"]: r["text"] for r in newest(spark, path).collect()} == {"a": "1", "b": "2", "c": "3"}
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["v=2", "v=3"]


def test_filters_reach_the_search(spark):
    from lodestar.api import Engine

    fields = "chunk_id long, text string, company string, filing_type string, filing_date string, section string"
    corpus = spark.createDataFrame([(i, "net income of the bank", c, t, "2023-01-01", "s") for i, (c, t) in enumerate([("AA", "10-K"), ("AA", "10-Q"), ("BB", "10-K")])], fields)
    vectors = encoding.passages(corpus, stub, 3)
    facts = spark.createDataFrame([], "fact_id string, company string, concept string, value double, unit string, fiscal_period string, period_type string, period_start string, period_end string, accession_number string, source_url string")
    told = lambda p: p.select("query_id", F.lit("See [1].").alias("reply"))
    engine = Engine(corpus, vectors, facts, lambda q: encoding.queries(q, stub, 3), generate=told)
    asked = spark.createDataFrame([(1, "how is the bank doing?")], "query_id long, question string")
    hits = lambda **f: {r["chunk_id"] for r in engine.search(asked, 10, f).collect()}
    assert (hits(), hits(company="AA"), hits(company="AA", filing_type="10-K")) == ({0, 1, 2}, {0, 1}, {0})
