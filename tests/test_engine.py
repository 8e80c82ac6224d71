import json

import pytest
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.api import Engine
from lodestar.config import Profiles, guard_output
from lodestar.operators.tracking import flatten
from lodestar.sources import files
from lodestar.sources.http import Fetcher
from lodestar.streaming.ingest import index_stream, newest


def chunk(i, text, **more):
    row = dict(company="COLB", filing_type="10-K", filing_date="2024-01-01", accession_number="a", source_url="u", chunk_type="paragraph", hierarchy_level=2,
               parent_chunk_id=None, chunk_index=i, section=None, text=text, chunk_id=f"c{i}", token_count=1)
    return row | more


def test_stream_upserts_batches(spark, tmp_path):
    source, index, point = (str(tmp_path / n) for n in ("in", "index", "point"))
    (tmp_path / "in").mkdir()
    for name, rows in (("1", [chunk(1, "a"), chunk(2, "b")]), ("2", [chunk(2, "new"), chunk(3, "c")])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
        index_stream(spark, source, index, point).awaitTermination()
    assert {r["chunk_id"]: r["text"] for r in newest(spark, index).collect()} == {"c1": "a", "c2": "new", "c3": "c"}


def test_append_is_resumable(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    files.append_new(df, path, "id")
    files.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), path, "id")
    assert sorted(r["id"] for r in files.appended(spark, path, df.schema).collect()) == [1, 2, 3]


def test_eval_set_needs_splits(spark, tmp_path):
    path = str(tmp_path / "e.jsonl")
    (tmp_path / "e.jsonl").write_text('{"eval_id": "1", "split": "dev"}\n\n{"eval_id": "2"}\n')
    assert files.eval_set(spark, path).count() == 2
    with pytest.raises(ValueError, match="1 entries"):
        files.eval_set(spark, path, "dev")
    with pytest.raises(ValueError, match="no such split"):
        files.eval_set(spark, path, "val")


def test_facts_prune_by_company(spark, tmp_path):
    rows = spark.createDataFrame([("A", "Assets"), ("B", "Assets")], "company string, concept string")
    full = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in spark.createDataFrame([], schemas.FACT).dtypes))
    files.write_facts(full, str(tmp_path / "f"))
    one = files.facts(spark, str(tmp_path / "f"), "A")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(company" in one._jdf.queryExecution().executedPlan().toString()


def test_profiles():
    p = Profiles({"models": {"embedding": "m"}, "index": {"name": "i"}}, {"bad": {"models": {"embedding": "n"}}, "good": {"models": {"embedding": "n"}, "index": {"name": "j"}}})
    assert p.load("good", {}).index == "j" and p.load(None, {"LODESTAR_INDEX": "k"}).index == "k"
    with pytest.raises(ValueError):
        p.load("bad", {})
    with pytest.raises(KeyError):
        p.load("none", {})
    with pytest.raises(ValueError):
        guard_output("x", "r.json", "r.json")


def test_flatten():
    assert flatten({"a": {"b": 1, "ok": True}, "l": list(range(101)), "per_query": [1]}) == {"a.b": 1} | {f"l.{i}": i for i in range(100)}


def test_fetcher_waits_and_skips(tmp_path):
    now, waits = [0.0], []

    class Reply:
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None
        read = lambda self: b"x"

    f = Fetcher("me", rate=8, open_url=lambda r, timeout: Reply(), clock=lambda: now[0], sleep=waits.append)
    f.save("http://a", tmp_path / "a")
    f.save("http://a", tmp_path / "a")
    f.save("http://b", tmp_path / "b")
    assert waits == [0.125]


def test_engine_answers(spark):
    corpus = spark.createDataFrame([chunk(1, "deposits grew in oregon"), chunk(2, "loans fell")], schemas.CHUNK).withColumn("chunk_id", F.substring("chunk_id", 2, 9).cast("long"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    fact = spark.createDataFrame([("COLB", "Assets", 5e9, "USD", "FY", "instant", "1", "url", None, "2023-12-31", "f")], schemas.FACT)
    engine = Engine(corpus, vectors, fact, lambda q: q.select(F.col("query_id").alias("id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding")),
                    generate=lambda df: df.withColumn("answer", F.lit("They grew [1]. Not [9].")))
    asked = spark.createDataFrame([(1, "Total assets of Columbia in 2023?"), (2, "Why did deposits grow?")], "query_id long, question string")
    out = {r["query_id"]: r for r in engine.ask(asked).collect()}
    assert out[1]["route"] == "structured" and "$5.00 billion" in out[1]["answer"] and out[2]["route"] == "semantic" and len(out[2]["sources"]) == 1
    with pytest.raises(ValueError):
        engine.search(asked, 51)
    with pytest.raises(Exception, match="3 to 1000"):
        engine.route(spark.createDataFrame([(1, "x")], asked.schema)).collect()
