import json
import random

import pytest
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.config import guard_judgments, guard_output, independent, read_report
from lodestar.functions.storage import size_bytes
from lodestar.operators import encoding, generation, measurement, sampling
from lodestar.sources import files


def test_whole_json_files_of_facts(spark, tmp_path):
    facts = {"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2023-12-31", "val": 5, "accn": "0001-23-1", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-01-01", "frame": "CY2023"}]}}}}}
    (tmp_path / "colb.json").write_text(json.dumps(facts, indent=1))
    (tmp_path / "none.json").write_text(json.dumps(facts))
    out = files.company_facts(spark, str(tmp_path), spark.createDataFrame([("COLB", "0000887343")], "company string, cik string")).collect()
    assert [(r["company"], r["concept"], r["value"]) for r in out] == [("COLB", "Assets", 5.0)]


def test_pages_are_read_as_bytes_of_all_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.htm").write_bytes(b"<p>\xff</p>")
    (tmp_path / "y.htm").write_bytes(b"y")
    assert sorted(bytes(r["html"]) for r in files.filings_html(spark, str(tmp_path)).collect()) == [b"<p>\xff</p>", b"y"]


def test_json_by_company_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "company string, n int")
    files.write_json(rows, str(tmp_path / "out"))
    files.write_json(rows.where("n = 2"), str(tmp_path / "out"))  # a later run replaces all
    assert [p.name for p in sorted((tmp_path / "out").glob("company=*"))] == ["company=B"]
    files.write_report({"ä": [1]}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == '{\n  "ä": [\n    1\n  ]\n}\n'


def test_indexes_are_made_copied_and_read_by_ids(spark, tmp_path):
    path, schema = str(tmp_path / "i"), spark.createDataFrame([], "chunk_id string, text string, n int").schema
    files.create_index(spark, path, schema)
    spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], schema).write.mode("append").parquet(path)
    files.create_index(spark, path, schema)  # stays
    assert files.index_count(spark, path) == 2
    assert files.copy_index(spark.read.parquet(path), str(tmp_path / "copy"), "chunk_id", "n") == 2
    assert spark.read.parquet(str(tmp_path / "copy")).columns == ["chunk_id", "n"]
    ids = spark.createDataFrame([("b",), ("b",), ("z",)], "chunk_id string")
    assert [tuple(r) for r in files.by_ids(spark.read.parquet(path), ids, "text").collect()] == [("b", "y")]
    files.create_index(spark, path, schema, recreate=True)
    assert files.index_count(spark, path) == 0


def test_sizes_are_taken_once_they_rest(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(100).write.parquet(path)
    steps = []

    def grow(seconds):
        if len(steps) < 2:
            (tmp_path / "s" / f"more{len(steps)}").write_bytes(b"x" * 10)
        steps.append(seconds)

    (tmp_path / "s" / "_mark").write_bytes(b"123")
    data = files.data_bytes(spark, path)
    found = files.settled_size(spark, path, sleep=grow)
    assert found["data"] == data + 20 and found["store"] == size_bytes(spark, path) > found["data"] and len(steps) == 3
    with pytest.raises(TimeoutError):
        files.settled_size(spark, path, attempts=1, sleep=lambda s: None)


def test_prompts_for_questions(spark):
    row = spark.createDataFrame([("COLB", "10-K", None, " text ")], "company string, filing_type string, filing_date string, text string")
    text = row.select(generation.question_prompt(5).alias("p")).first()["p"]
    assert text.startswith("Write 5 different") and "--- PASSAGE (COLB 10-K filed ?) ---\ntext\n\n--- QUESTIONS ---" in text


def test_labelled_ids_and_grids(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["b"],), ([],)], "relevant_chunk_ids array<string>")
    assert sorted(r["chunk_id"] for r in sampling.labelled_ids(rows).collect()) == ["a", "b"]
    assert measurement.build_grid([8, 16], [64]) == [{"m": 8, "ef_construction": 64}, {"m": 16, "ef_construction": 64}]
    row = spark.range(1).select(measurement.degradation(F.lit(0.5), F.lit(0.41239)).alias("d"), measurement.speedup(F.lit(10.0), F.lit(4.0)).alias("s"), measurement.speedup(F.lit(1.0), F.lit(0.0)).alias("i")).first()
    assert tuple(row) == (-0.0876, 2.5, float("inf"))


def test_guards(tmp_path):
    path = str(tmp_path / "r.json")
    guard_judgments(path, {"split": "dev", "judged_answers": 0})  # nothing to lose yet
    files.write_report({"split": "dev", "judged_answers": 9}, path)
    with pytest.raises(ValueError, match="9 judged answers, the new report 8"):
        guard_judgments(path, {"split": "dev", "judged_answers": 8})
    guard_judgments(path, {"split": "dev", "judged_answers": 9})
    guard_judgments(path, {"split": "all", "judged_answers": 0})
    for broken in ("{", "[1]", '{"split": "dev", "judged_answers": {"n": 9}}', '{"split": "dev", "judged_answers": "many"}', '{"split": "dev", "judged_answers": null}'):
        (tmp_path / "r.json").write_text(broken)
        guard_judgments(path, {"split": "dev", "judged_answers": 0})
    assert read_report(str(tmp_path / "none")) is None
    guard_output(None, "b", "b", "run", "run")
    guard_output("p", "a", "b", "own", "run")
    with pytest.raises(ValueError, match="logged as run"):
        guard_output("p", "a", "b", "run", "run")


def test_a_judge_is_another_model():
    one = {"backend": "x", "model": "m"}
    assert not independent(one, dict(one)) and independent(one, one | {"model": "n"}) and independent(one, one | {"backend": "y"})


def test_devices():
    assert encoding.device("cuda:1", lambda d: False) == "cuda:1" and encoding.device(None, lambda d: True) == "mps"
    assert encoding.device(None, lambda d: d == "cuda") == "cuda" and encoding.device("", lambda d: False) == "cpu"


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_contamination_equals_all_pairs(spark, threshold):
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(12)], [f"rarelongword{i}" for i in range(300)]
    held = [" ".join(rng.sample(common, rng.randrange(1, 8)) + rng.sample(rare, rng.randrange(0, 3))) for _ in range(40)] + ["", None, "c1"]
    asked = [" ".join(rng.sample(common, rng.randrange(0, 8)) + rng.sample(rare, rng.randrange(0, 3))) for _ in range(300)] + held
    rows = [(i, t) for i, t in enumerate(asked)] + [(3, asked[5])]
    words = lambda t: set((t or "").split())
    near = lambda t: not words(t) or any(words(h) and len(words(t) & words(h)) / len(words(t) | words(h)) >= threshold for h in held)
    want = {i: False for i, _ in rows}
    for i, t in rows:
        want[i] |= near(t) if t is not None else False
    out = sampling.contaminated(spark.createDataFrame(rows, "query_id int, text string"), spark.createDataFrame([(h,) for h in held], "text string"), threshold=threshold)
    found = {}
    for r in out.collect():
        found[r["query_id"]] = found.get(r["query_id"], False) | r["contaminated"]
    assert {i: x for i, x in found.items() if asked[i] is not None} == {i: x for i, x in want.items() if asked[i] is not None} and out.count() == len(rows)


def test_schemas_name_what_is_read():
    assert "chunk_id" in schemas.CHUNK and "split" in schemas.EVAL_ENTRY
