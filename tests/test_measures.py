import json
import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest

from lodestar.operators import measurement
from lodestar.operators.measurement import latency_summary, percentiles
from lodestar.operators.tracking import flatten, flatten_reports


def plain(values, share):
    ordered = sorted(values, key=lambda x: (math.isnan(x), x))
    return ordered[max(1, min(len(ordered), int(Decimal(share * len(ordered)).quantize(Decimal(1), ROUND_HALF_EVEN)))) - 1]


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_percentiles_are_those_of_a_sorted_list(spark, monkeypatch, accuracy):
    monkeypatch.setattr(measurement, "ACCURACY", accuracy)  # rough ranges give the same values
    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3001)], "b": [1.0], "c": [5.0] * 700 + [6.0], None: [rng.choice([1.5, 2.5]) for _ in range(40)], "d": [math.inf, -math.inf, 0.0, -0.5]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    shares = (0.0, 0.25, 0.5, 0.95, 0.999, 1.0)
    df = spark.createDataFrame(rows, "g string, ms double").repartition(5)
    found = {(r["g"], r["share"]): (r["value"], r["n"]) for r in percentiles(df, shares, "g").collect()}
    assert found == {(k, s): (plain(vs, s), len(vs)) for k, vs in groups.items() for s in shares}
    whole = {r["share"]: r["value"] for r in percentiles(df, (0.5,)).collect()}
    assert whole == {0.5: plain([v for vs in groups.values() for v in vs], 0.5)}


def test_percentiles_gather_no_group(spark):
    df = spark.range(1000).selectExpr("id % 2 as g", "double(id) as ms")
    plan = percentiles(df, (0.5,), "g")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Window ") == 1
    summary = {r["g"]: tuple(r)[1:] for r in latency_summary(df, "g").collect()}
    assert summary == {0: (499.0, plain(range(0, 1000, 2), 0.5), plain(range(0, 1000, 2), 0.95), 500), 1: (500.0, plain(range(1, 1000, 2), 0.5), plain(range(1, 1000, 2), 0.95), 500)}
    assert percentiles(df.limit(0), (0.5,), "g").count() == 0


def test_reports_flatten_as_one_does(spark):
    reports = {
        1: {"a": {"b": 1, "ok": True, "c": None, "t": "7"}, "l": list(range(130)), "per_query": [1], "x": 2.5},
        2: {"deep": [[{"k": [1, {"unsupported": 3, "z": -4}]}]], "e": {}, "f": []},
        3: [1, 2, {"a.b": 3}],
        4: 5,
        5: {"unsupported": {"n": 1}, "big": 12345678901234567890, "small": 1e-9},
    }
    rows = [(i, json.dumps(r)) for i, r in reports.items()] + [(6, "no json"), (7, None), (8, '"text"')]
    df = spark.createDataFrame(rows, "run int, report string")
    found = {}
    for r in flatten_reports(df, "run").collect():
        found.setdefault(r["run"], {})[r["metric"]] = r["value"]
    want = {i: {k: float(v) for k, v in flatten(r).items()} for i, r in reports.items()}
    assert found == {i: m for i, m in want.items() if m}
    variants = df.where("run < 3").selectExpr("run", "parse_json(report) as report")
    assert flatten_reports(variants, "run").count() == len(want[1]) + len(want[2])
    assert flatten_reports(df.limit(0), "run").count() == 0
