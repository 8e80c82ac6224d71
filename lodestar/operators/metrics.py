"""Rank metrics over (query_id, retriever, rank, chunk_id) and labels (query_id, chunk_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.storage import small

CUTS = (1, 3, 5, 10, 20)


def per_query(ranked: DataFrame, labels: DataFrame, retrievers: DataFrame | None = None, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row a (query_id, retriever) of the labelled queries: its metrics, n_relevant and first_rank (null: none found).

    Reciprocal rank and average precision see the whole list. A query that a retriever found
    nothing for has zeros.
    """
    labels = labels.select("query_id", "chunk_id").distinct()
    counts = labels.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    names = ranked.select("retriever").distinct() if retrievers is None else retrievers
    grid = counts.join(small(names))
    hits = ranked.select("query_id", "retriever", "rank", "chunk_id").join(labels, ["query_id", "chunk_id"])
    order = Window.partitionBy("query_id", "retriever").orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(order))
    gain = 1 / F.log2(F.col("rank") + 1)
    found = hits.groupBy("query_id", "retriever").agg(
        F.min("rank").alias("first_rank"),
        F.sum(F.col("nth") / F.col("rank")).alias("ap"),
        *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in cuts),
        *(F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}") for k in cuts),
    )
    out = grid.join(found, ["query_id", "retriever"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))

    def ideal(k: int) -> Column:
        ranks = F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int"))
        return F.aggregate(ranks, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))

    return out.select(
        "query_id", "retriever", "n_relevant", "first_rank",
        *((zero(f"hits_{k}") / F.col("n_relevant")).alias(f"recall_at_{k}") for k in cuts),
        *((zero(f"hits_{k}") > 0).cast("double").alias(f"hit_rate_at_{k}") for k in cuts),
        *((zero(f"dcg_{k}") / ideal(k)).alias(f"ndcg_at_{k}") for k in cuts),
        F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        (zero("ap") / F.col("n_relevant")).alias("map"),
    )


def metric_names(scored: DataFrame) -> list[str]:
    return [c for c in scored.columns if c in ("mrr", "map") or "_at_" in c]


def averaged(scored: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """Means of per_query by retriever and the columns by; labelled queries only, a miss counts 0."""
    means = [F.round(F.avg(c), digits).alias(c) for c in metric_names(scored)]
    return scored.groupBy("retriever", *by).agg(F.count("*").alias("n_queries"), *means)


def grouped(scored: DataFrame, *groups: str, digits: int = 6) -> DataFrame:
    """Overall and by each of groups in one pass: (retriever, group, value, n_queries, …)."""
    means = [F.round(F.avg(c), digits).alias(c) for c in metric_names(scored)]
    sets = [["retriever"], *(["retriever", g] for g in groups)]
    out = scored.groupingSets(sets, "retriever", *groups).agg(F.count("*").alias("n_queries"), *means, F.grouping_id().alias("_id"))
    n = len(groups)
    name, value = F.lit("overall"), F.lit(None).cast("string")
    for i, g in enumerate(groups):
        of = F.col("_id").bitwiseAND(F.lit((1 << n) - 1)) == (1 << n) - 1 - (1 << (n - 1 - i))
        name, value = F.when(of, g).otherwise(name), F.when(of, F.col(g).cast("string")).otherwise(value)
    return out.select("retriever", name.alias("group"), value.alias("value"), "n_queries", *metric_names(scored))


def deltas(means: DataFrame, base: str, digits: int = 4) -> DataFrame:
    """Each retriever's means less those of base: (retriever, metric, delta)."""
    names = metric_names(means)
    long = means.select("retriever", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("metric", "value"))
    other = long.where(F.col("retriever") == base).select("metric", F.col("value").alias("base"))
    return long.where(F.col("retriever") != base).join(other, "metric").select("retriever", "metric", F.round(F.col("value") - F.col("base"), digits).alias("delta"))


def repeated_ids(ranked: DataFrame) -> DataFrame:
    """Ids that a ranked list holds twice; metrics need lists without."""
    return ranked.groupBy("query_id", "retriever", "chunk_id").agg(F.count("*").alias("n")).where("n > 1")
