import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import plans
from lodestar.functions.storage import new_path
from lodestar.operators import ivf, retrieval
from lodestar.operators.measurement import ann_recall, measure_point

DIR = "/root/testdata/sf0.01"


def unit(rng, n, dims):
    v = rng.standard_normal((n, dims)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, vectors, **columns):
    rows = [(i, [float(x) for x in v], *(c[i] for c in columns.values())) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, embedding array<float>" + "".join(f", {n} string" for n in columns))


@pytest.fixture(scope="module")
def clustered(spark):
    """1,200 vectors around 12 points, every twentieth of them a query."""
    rng = np.random.default_rng(2)
    centers = unit(rng, 12, 16)
    v = centers[rng.integers(0, 12, 1200)] + 0.08 * rng.standard_normal((1200, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = table(spark, v, kind=["rare" if i % 40 == 0 else "usual" for i in range(1200)])
    return df, ivf.build(df, new_path(spark, "cells"), cells=30)


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return out


def test_every_vector_is_stored_in_the_cell_of_its_nearest_centroid(clustered):
    df, index = clustered
    stored = {r["id"]: r for r in index.vectors.collect()}
    centroids = {r["cell"]: r for r in index.centroids.collect()}
    assert set(stored) == set(range(1200)) and sum(r["n"] for r in centroids.values()) == 1200
    c = np.array([centroids[i]["centroid"] for i in sorted(centroids)])
    assert all(np.isclose((c @ np.array(r["embedding"])).max(), c[r["cell"]] @ np.array(r["embedding"])) for r in stored.values())
    assert np.allclose(np.linalg.norm(c, axis=1), 1)


def test_an_ef_of_all_rows_is_exact(clustered):
    df, index = clustered
    asked = df.where("id % 100 = 0")
    assert lists(ivf.nearest_in_cells(asked, index, 10, 1200)) == lists(retrieval.nearest(asked, df, 10))
    assert lists(ivf.nearest_in_cells(asked, index, 10, 1200, exclude_self=True)) == lists(retrieval.nearest(asked, df, 10, exclude_self=True))


def test_near_cells_hold_the_neighbours_of_clustered_vectors(clustered):
    df, index = clustered
    asked = df.where("id % 20 = 0")
    points = {r["ef"]: r for r in ivf.curve(asked, index, retrieval.nearest(asked, df, 10), 10, [10, 60, 120]).collect()}
    assert points[120]["recall"] >= 0.95 and points[120]["scored"] < 0.2
    assert points[10]["recall"] <= points[60]["recall"] <= points[120]["recall"] and points[10]["read"] < points[120]["read"]


def test_filters_count_for_the_cells_to_probe(clustered):
    df, index = clustered
    asked = df.where("id in (1, 500, 777)")
    found = lists(ivf.nearest_in_cells(asked, index, 10, 10, {"kind": "rare"}))
    assert all(len(x) == 10 and all(i % 40 == 0 for i, _ in x) for x in found.values()) and len(found) == 3
    assert lists(ivf.nearest_in_cells(asked, index, 30, 30, {"kind": "rare"})) == lists(retrieval.nearest(asked, df, 30, {"kind": "rare"}))
    assert ivf.nearest_in_cells(asked, index, 10, filters={"kind": "none"}).count() == 0


def test_a_knob_below_k_is_an_error(clustered):
    with pytest.raises(ValueError, match="below k"):
        ivf.nearest_in_cells(clustered[0], clustered[1], 10, 9)


def test_a_search_reads_the_probed_cells_only_where_they_are_dealt(clustered, monkeypatch):
    df, index = clustered
    asked = df.where("id % 20 = 0")
    want = lists(ivf.nearest_in_cells(asked, index, 10, 120))
    monkeypatch.setattr(ivf, "PART_ROWS", 7)  # every cell in many parts, queries too
    monkeypatch.setattr(ivf, "PART_QUERIES", 3)
    assert lists(ivf.nearest_in_cells(asked, index, 10, 120)) == want
    plan = index.vectors.where("cell = 3").select("code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "embedding" not in plan


def test_copies_of_one_vector_and_odd_tables(spark):
    same = table(spark, np.tile(unit(np.random.default_rng(1), 1, 8), (300, 1)))
    index = ivf.build(same, new_path(spark, "cells"))
    assert [c for c, _ in lists(ivf.nearest_in_cells(same.where("id = 7"), index, 5))[7]] == [0, 1, 2, 3, 4]
    assert ivf.nearest_in_cells(same.limit(0), index, 5).count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        ivf.build(same.limit(0), new_path(spark, "cells"))
    with pytest.raises(ValueError, match="no index"):
        ivf.opened(spark, new_path(spark, "cells"))
    assert ivf.opened(spark, index.path).vectors.count() == 300


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_recall_of_nine_tenths_with_under_a_fifth_scored(spark):
    """The vectors of this table lie all around, so cells alone don't help: codes do."""
    point = plans.QUERIES["ann_curve"](spark, DIR).orderBy(F.desc("ef")).first()
    assert point["recall"] >= 0.9 and point["scored"] < 0.2
    v = plans.search.vectors(spark, DIR)
    exact = retrieval.nearest(v.where("id % 20 = 0"), v, 10, exclude_self=True)
    assert ann_recall(exact, plans.QUERIES["knn_ivf"](spark, DIR), 10).agg({"recall": "avg"}).first()[0] >= 0.9


def test_a_point_of_the_curve_is_measured(clustered):
    df, index = clustered
    asked = df.where("id % 100 = 0")
    point = measure_point(lambda q: ivf.nearest_in_cells(q, index, 5, 100), asked, retrieval.nearest(asked, df, 5), 5, repeats=2)
    assert point["deterministic"] and point["recall"] >= 0.9 and point["n"] == 12


def test_probes_of_all_cells_are_handed_on_in_bounded_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(120)], "id long, embedding array<float>")
    index = ivf.build(rows, new_path(spark, "cells"), cells=6)
    want = sorted((r["query_id"], r["cell"]) for r in ivf.probes(rows, index, 1000).collect())
    monkeypatch.setattr(ivf, "PROBES", 12)
    seen = []
    plain = ivf.matrix
    monkeypatch.setattr(ivf, "matrix", lambda column, dims=None: (seen.append(len(column)), plain(column, dims))[1])

    class Asked:
        """The batches that probes hands to Spark, run here."""

        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, run, schema):  # noqa: N802
            import pyarrow as pa

            table = rows.toArrow().select(["id", "embedding"])
            return [b for b in run(iter(table.combine_chunks().to_batches())) if isinstance(b, pa.RecordBatch)]

    out = ivf.probes(Asked(), index, 1000)
    assert sorted(zip((q for b in out for q in b.column(0).to_pylist()), (c for b in out for c in b.column(2).to_pylist()), strict=True)) == want
    assert max(b.num_rows for b in out) <= 12 and max(seen) <= 12
