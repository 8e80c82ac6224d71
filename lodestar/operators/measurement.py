"""ANN curves, latency, vector fidelity and index parity."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.storage import BROADCAST_ROWS, cut
from lodestar.functions.vectors import dot, norm
from lodestar.operators.evaluation import lists

#: How far norms, scores, cosines and metrics may differ, and the recall asked for.
NORM_ERROR, SCORE_ERROR, OWN_COSINE, OTHER_COSINE, TARGET_RECALL = 1e-3, 1e-6, 0.999, 0.99, 0.99


def ann_recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the exact first k among the approximate first k; 0 without exact ones."""
    a = lists(exact.where(F.col("rank") <= k), "query_id")
    b = lists(approximate.where(F.col("rank") <= k), "query_id").withColumnRenamed("ids", "other")
    common = F.size(F.array_intersect("ids", F.coalesce("other", F.array().cast("array<bigint>"))))
    return a.join(b, "query_id", "left").select("query_id", F.coalesce(F.try_divide(common, F.size("ids")), F.lit(0.0)).alias("recall"))


#: The accuracy of the sketch that says in which range a percentile lies: ranks are off by a share of one in so many at most.
ACCURACY = 10_000


def percentiles(rows: DataFrame, shares: Sequence[float], *by: str, value: str = "ms") -> DataFrame:
    """(by, share, value, n): percentiles without interpolation: the value at the share of the count, rounded half to even, from 1 to the count.

    Exact in two passes, and no group is gathered. A sketch gives each a range that holds it; then values below the range are counted,
    and those inside it by value: some four in ACCURACY of a group's rows, and their ties as one. Nulls don't count, NaN is the greatest.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    ends = [min(1.0, max(0.0, s + d / ACCURACY)) for s in shares for d in (-2, 2)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("ends"), F.min("v").alias("least"), F.max("v").alias("most"))
    few = F.col("n") <= ACCURACY  # a rank more or less is beyond the sketch's share, and all values are few
    end = lambda i, whole: F.when(few, F.col(whole)).otherwise(F.col("ends")[i])
    targets = F.array(*(F.struct(F.lit(float(s)).alias("share"), end(2 * i, "least").alias("lo"), end(2 * i + 1, "most").alias("hi")) for i, s in enumerate(shares)))
    targets = sketch.where("n > 0").select(*(F.col(c).alias(f"of_{c}") for c in by), "n", F.explode(targets).alias("t")).select(*(f"of_{c}" for c in by), "n", "t.*")
    targets = cut(targets, "ranges")  # the sketch isn't made again for the second pass
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by), F.lit(True))
    side = targets if targets.count() > BROADCAST_ROWS else F.broadcast(targets)
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("share") * F.col("n")).cast("long"))).alias("rank")
    inside = rows.join(side, same & (F.col("v") <= F.col("hi"))).groupBy(*by, "share", "n", rank, F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("times"))
    up_to = F.sum("times").over(Window.partitionBy(*by, "share").orderBy(F.col("v").asc_nulls_first()))
    reached = inside.withColumn("up_to", up_to).where(F.col("up_to") >= F.col("rank"))
    found = reached.groupBy(*by, "share", "n").agg(F.min_by(F.struct("v"), "up_to").alias("at"))
    held = F.when(F.col("at.v").isNull(), F.raise_error(F.lit("a percentile lies outside of its range")).cast("double")).otherwise(F.col("at.v"))
    return found.select(*by, "share", held.alias("value"), "n")


def latency_summary(runs: DataFrame, *by: str, value: str = "ms") -> DataFrame:
    """(by, mean, p50, p95, n)."""
    at = percentiles(runs, (0.5, 0.95), *by, value=value).groupBy(*by).agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(p) for s, p in ((0.5, "p50"), (0.95, "p95"))))
    means = runs.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.count(value).alias("n"))
    same = reduce(lambda a, b: a & b, (means[c].eqNullSafe(at[c]) for c in by), F.lit(True))
    return means.join(at, same, "left").select(*(means[c] for c in by), "mean", "p50", "p95", "n")


def search_points(asked: str | Column, k: int) -> Column:
    """Knob settings to measure: the default (null), then the distinct ones of at least k, ascending."""
    asked = F.col(asked) if isinstance(asked, str) else asked
    return F.concat(F.array(F.lit(None).cast("int")), F.array_sort(F.array_distinct(F.filter(asked, lambda x: x >= k))))


def operating_point(curve: DataFrame, *by: str, target: float = TARGET_RECALL) -> DataFrame:
    """curve (by, ef, recall, p95): the cheapest point that meets the target, else that of the best recall; met says which."""
    cost = F.struct("p95", F.coalesce("ef", F.lit(0)))
    point = F.struct("ef", "recall", "p95")
    meets = F.col("recall") >= target
    out = curve.groupBy(*by).agg(
        F.min_by(F.when(meets, point), F.when(meets, cost)).alias("good"),
        F.max_by(point, F.struct("recall", -F.col("p95"), -F.coalesce("ef", F.lit(0)))).alias("best"),
    )
    chosen = F.coalesce("good", "best")
    return out.select(*by, *(chosen[f].alias(f) for f in ("ef", "recall", "p95")), F.col("good").isNotNull().alias("met"))


def list_verdicts(one: DataFrame, two: DataFrame, tolerance: float = SCORE_ERROR) -> DataFrame:
    """(query_id, verdict) of two ranked lists: identical; tied, where only equal scores changed places, also at the cut; or different."""
    a = one.select("query_id", "rank", F.col("chunk_id").alias("id1"), F.col("score").alias("s1"))
    b = two.select("query_id", "rank", F.col("chunk_id").alias("id2"), F.col("score").alias("s2"))
    both = a.join(b, ["query_id", "rank"], "full")
    same_score = F.abs(F.col("s1") - F.col("s2")) <= tolerance
    by = both.groupBy("query_id").agg(
        F.bool_and(F.coalesce(F.col("id1") == F.col("id2"), F.lit(False))).alias("same"),
        F.bool_and(F.coalesce(same_score, F.lit(False))).alias("scores"),
        F.min("s1").alias("cut"),
    )
    # an id that only one list has must tie with the last score
    alone = one.join(two.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "score")
    alone = alone.unionByName(two.join(one.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "score"))
    odd = alone.join(by.select("query_id", "cut"), "query_id").groupBy("query_id").agg(F.bool_and(F.abs(F.col("score") - F.col("cut")) <= tolerance).alias("at_cut"))
    out = by.join(odd, "query_id", "left")
    tied = F.col("scores") & F.coalesce("at_cut", F.lit(True))
    return out.select("query_id", F.when(F.col("same"), "identical").when(tied, "tied").otherwise("different").alias("verdict"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """(verdict, n); the lists agree if none is different."""
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


def norm_error(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(n, max_error, ok): the farthest norm from 1."""
    error = F.max(F.abs(norm(embedding) - 1))
    return vectors.agg(F.count("*").alias("n"), F.round(error, 6).alias("max_error"), (error <= NORM_ERROR).alias("ok"))


def fidelity(one: DataFrame, two: DataFrame, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """(n, mean_cosine, min_cosine) of the vectors that both sets have."""
    both = one.select(key, embedding).join(two.select(key, F.col(embedding).alias("other")), key)
    cosine = dot(embedding, "other") / (norm(embedding) * norm("other"))
    return both.agg(F.count("*").alias("n"), F.round(F.avg(cosine), 6).alias("mean_cosine"), F.round(F.min(cosine), 6).alias("min_cosine"))


def contract(vectors: DataFrame, dims: int, embedding: str = "embedding") -> DataFrame:
    """(n, wrong_dims, max_norm_error, ok) of an encoder's output."""
    wrong = F.count_if(F.size(embedding) != dims)
    error = F.max(F.abs(norm(embedding) - 1))
    return vectors.agg(F.count("*").alias("n"), wrong.alias("wrong_dims"), F.round(error, 6).alias("max_norm_error"), ((wrong == 0) & (error <= NORM_ERROR)).alias("ok"))


def sides_apart(queries: DataFrame, passages: DataFrame, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """(n, max_cosine, ok) of texts encoded both as queries and as passages: an encoder that gives both the same lost its prefix."""
    both = queries.select(key, embedding).join(passages.select(key, F.col(embedding).alias("other")), key)
    most = F.max(dot(embedding, "other") / (norm(embedding) * norm("other")))
    return both.agg(F.count("*").alias("n"), F.round(most, 6).alias("max_cosine"), F.coalesce(most < OWN_COSINE, F.lit(False)).alias("ok"))


def measure_point(search: Callable[[DataFrame], DataFrame], queries: DataFrame, exact: DataFrame, k: int, repeats: int = 3, warm_up: int = 8) -> dict[str, object]:
    """One point of an ANN curve: search (queries -> query_id, chunk_id, rank) after a warm-up, repeats times over all queries.

    recall is against exact, n_exact counts the lists that equal it, and deterministic says whether
    all repeats gave the same lists. Queries run as a set, so ms are of a whole pass by the query.
    """
    if repeats < 1:
        raise ValueError("a point needs one repeat at least")
    n = queries.count()
    search(queries.limit(warm_up)).count()
    passes, prints = [], set()
    for _ in range(repeats):
        started = time.perf_counter()
        one = lists(search(queries).where(F.col("rank") <= k), "query_id").agg(F.count("*"), F.sum(F.xxhash64("query_id", "ids").cast("decimal(20,0)"))).first()
        passes.append(1000 * (time.perf_counter() - started) / max(n, 1))
        prints.add(tuple(one))
    found, truth = search(queries), exact.where(F.col("rank") <= k)
    recalls = ann_recall(truth, found, k).agg(F.avg("recall").alias("mean"), F.min("recall").alias("least")).first()
    same = lists(truth, "query_id").join(lists(found.where(F.col("rank") <= k), "query_id").withColumnRenamed("ids", "other"), "query_id").where(F.col("ids") == F.col("other"))
    return {"k": k, "n": n, "recall": recalls["mean"], "recall_min": recalls["least"], "n_exact": same.count(), "ms": passes, "deterministic": len(prints) == 1}


def justification(chosen: Mapping[str, float], default: Mapping[str, float], target: float = TARGET_RECALL) -> str:
    """Why a point (ef, recall, p95) was taken rather than the default, from the figures alone."""
    if chosen["ef"] == default["ef"]:
        why = f"The default stays: recall {chosen['recall']:.3f}, p95 {chosen['p95']:.1f} ms"
    else:
        why = f"ef {chosen['ef']} has recall {chosen['recall']:.3f} for {default['recall']:.3f}, p95 {chosen['p95']:.1f} ms for {default['p95']:.1f} ms"
    return why + (f"; the target of {target:.2f} is met." if chosen["recall"] >= target else f"; no point meets the target of {target:.2f}, this one comes nearest.")


def identity_problems(expected: Mapping[str, object], reported: Mapping[str, object]) -> list[str]:
    """Each way in which a service's profile, model or index is another than expected."""
    return [f"{part}: {reported.get(part)!r} is served, {want!r} was asked for" for part, want in expected.items() if reported.get(part) != want]


def degradation(base: Column, other: Column) -> Column:
    return F.round(other - base, 4)


def speedup(base: Column, other: Column) -> Column:
    return F.when(other == 0, F.lit(float("inf"))).otherwise(F.round(base / other, 3))


def count_problems(one: DataFrame, two: DataFrame, by: str) -> DataFrame:
    """(by, n_one, n_two) of the kinds whose counts differ; a kind that one side lacks counts 0."""
    a, b = (df.groupBy(by).agg(F.count("*").alias(f"n_{n}")) for df, n in ((one, "one"), (two, "two")))
    return a.join(b, by, "full").fillna(0, ["n_one", "n_two"]).where("n_one <> n_two")


def coverage_problems(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(side, key) of the ids that only one side has."""
    a, b = one.select(key).distinct(), two.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("one").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("two").alias("side"), key))


def sample_ids(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select(by, key)


def provenance_problems(cosines: DataFrame) -> DataFrame:
    """(index, n, bad): samples whose cosine with their own model is low or with the other is high; no sample is bad too."""
    bad = (F.col("own") < OWN_COSINE) | (F.col("other") > OTHER_COSINE)
    return cosines.groupBy("index").agg(F.count("chunk_id").alias("n"), F.count_if(bad).alias("bad")).withColumn("ok", (F.col("n") > 0) & (F.col("bad") == 0))


def build_grid(m: list[int], ef_construction: list[int]) -> list[dict[str, int]]:
    return [{"m": a, "ef_construction": b} for a in m for b in ef_construction]
