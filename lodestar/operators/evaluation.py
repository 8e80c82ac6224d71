"""Evaluations beside rank metrics: runs against runs, routing, extraction, groundedness, charts, splits' notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as equal.
RELATIVE_ERROR, ABSOLUTE_ERROR = 1e-6, 1.0


def lists(ranked: DataFrame, *by: str) -> DataFrame:
    """(by, ids) with the ids in the order of their ranks. A list is as long as its retrieval depth."""
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """(n_queries, same_order, same_members, mean_jaccard) of two runs over the queries that both have."""
    both = lists(one, "query_id").join(lists(two, "query_id").withColumnRenamed("ids", "other"), "query_id")
    common = F.size(F.array_intersect("ids", "other"))
    jaccard = F.try_divide(common, F.size(F.array_union("ids", "other")))
    return both.agg(
        F.count("*").alias("n_queries"),
        F.count_if(F.col("ids") == F.col("other")).alias("same_order"),
        F.count_if(F.array_sort("ids") == F.array_sort("other")).alias("same_members"),
        F.round(F.avg(jaccard), 6).alias("mean_jaccard"),
    )


def divergence(one: DataFrame, two: DataFrame) -> DataFrame:
    """(query_id, same_order, same_members, only_one, only_two): what each list has alone, in order."""
    both = lists(one, "query_id").join(lists(two, "query_id").withColumnRenamed("ids", "other"), "query_id")
    alone = lambda a, b: F.filter(F.col(a), lambda x: ~F.array_contains(F.col(b), x))
    return both.select(
        "query_id", (F.col("ids") == F.col("other")).alias("same_order"), (F.array_sort("ids") == F.array_sort("other")).alias("same_members"),
        alone("ids", "other").alias("only_one"), alone("other", "ids").alias("only_two"),
    )


def compared_groups(base: DataFrame, candidate: DataFrame, group: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """(group, n, metric, base, candidate, delta) over the queries that both runs scored."""
    pairs = base.select("query_id", group, *metrics).join(candidate.select("query_id", *(F.col(m).alias(f"c_{m}") for m in metrics)), "query_id")
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("b"), F.col(f"c_{m}").alias("c")) for m in metrics)))
    long = pairs.select(group, one.alias("m")).select(group, "m.*").groupBy(group, "metric")
    out = long.agg(F.count("*").alias("n"), F.avg("b").alias("b"), F.avg("c").alias("c"))
    return out.select(group, "metric", "n", F.round("b", digits).alias("base"), F.round("c", digits).alias("candidate"), F.round(F.col("c") - F.col("b"), digits).alias("delta"))


def unmatched(one: DataFrame, two: DataFrame, *on: str) -> DataFrame:
    """Rows of one that two lacks; arms that must agree leave none either way."""
    return one.select(*on).exceptAll(two.select(*on))


def arm_problems(runs: DataFrame, base: str = "bm25") -> DataFrame:
    """(check, arm, other, n): ways in which arms of a comparison don't fit together; none if they do.

    runs (arm, index, split, retriever, query_id, rank, chunk_id). Arms must have indexes of their
    own, the same questions in each split, and the same lists from the retriever that no arm changes.
    """
    arms = runs.select("arm", "index").distinct()
    two = lambda df, *on: df.join(df.withColumnRenamed("arm", "other"), list(on)).where("arm < other")
    shared = two(arms, "index").groupBy("arm", "other").agg(F.count("*").alias("n")).select(F.lit("same index").alias("check"), "arm", "other", "n")
    names = arms.select("arm").distinct()

    def differing(rows: DataFrame, check: str) -> DataFrame:
        """Rows that one arm has and another lacks."""
        on = [c for c in rows.columns if c != "arm"]
        each = rows.distinct().join(F.broadcast(names.withColumnRenamed("arm", "other")), F.col("arm") != F.col("other"))
        lacking = each.join(rows.distinct().withColumnRenamed("arm", "other"), ["other", *on], "left_anti")
        return lacking.groupBy("arm", "other").agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), "arm", "other", "n")

    found = differing(runs.select("arm", "split", "query_id"), "questions")
    lists_of = differing(runs.where(F.col("retriever") == base).select("arm", "split", "query_id", "rank", "chunk_id"), f"{base} lists")
    return shared.unionByName(found).unionByName(lists_of)


def extraction(expected: DataFrame, facts: DataFrame) -> DataFrame:
    """expected (eval_id, concept, accession_number, expected_value, kind) with the nearest value found and passed."""
    found = expected.join(facts.select("concept", "accession_number", "value"), ["concept", "accession_number"])
    nearest = found.groupBy("eval_id").agg(F.min_by("value", F.abs(F.col("value") - F.col("expected_value"))).alias("value"), F.count("*").alias("n_found"))
    out = expected.join(nearest, "eval_id", "left")
    error = F.try_divide(F.abs(F.col("value") - F.col("expected_value")), F.abs("expected_value"))
    passed = F.coalesce((error <= RELATIVE_ERROR) & (F.col("kind") == "xbrl_fact"), F.lit(False))
    return out.select("eval_id", "value", F.coalesce("n_found", F.lit(0)).alias("n_found"), error.alias("relative_error"), passed.alias("passed"))


def confusion(decided: DataFrame, expected: str = "expected_route", predicted: str = "route") -> DataFrame:
    return decided.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def routing_summary(decided: DataFrame, expected: str = "expected_route", predicted: str = "route") -> DataFrame:
    """(n, accuracy, structured_precision, structured_recall), null where there is nothing to divide by."""
    e, p = F.col(expected) == "structured", F.col(predicted) == "structured"
    right = F.count_if(e & p)
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return decided.agg(
        F.count("*").alias("n"), ratio(F.count_if(F.col(expected) == F.col(predicted)), F.count("*")).alias("accuracy"),
        ratio(right, F.count_if(p)).alias("structured_precision"), ratio(right, F.count_if(e)).alias("structured_recall"),
    )


def exact_values(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """expected (query_id, expected_value) against answered (query_id, value), within ABSOLUTE_ERROR."""
    out = expected.join(answered.select("query_id", "value"), "query_id", "left")
    return out.select("query_id", "value", F.coalesce(F.abs(F.col("value") - F.col("expected_value")) < ABSOLUTE_ERROR, F.lit(False)).alias("exact"))


def groundedness(rows: DataFrame, total_questions: int, split: str = "all") -> DataFrame:
    """One row of totals over rows (route, refused, n_citations, support_rate, judged)."""
    semantic = F.col("route") == "semantic"
    answered = semantic & ~F.coalesce("refused", F.lit(False))
    judged = answered & F.coalesce("judged", F.lit(False))
    rate = F.when(judged, F.col("support_rate"))
    n = lambda c: F.count_if(c)
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return rows.agg(
        F.lit(split).alias("split"),
        F.lit(total_questions).cast("long").alias("questions_in_eval_set"),
        F.count("*").alias("answers_generated"),
        F.coalesce(ratio(F.count("*"), F.lit(total_questions)), F.lit(0.0)).alias("coverage"),
        n(F.col("route") == "structured").alias("structured_route"),
        n(semantic).alias("semantic_route"),
        n(semantic & F.col("refused")).alias("refusals"),
        ratio(n(semantic & F.col("refused")), n(semantic)).alias("refusal_rate"),
        n(answered & (F.col("n_citations") > 0)).alias("answers_with_valid_citations"),
        ratio(n(answered & (F.col("n_citations") > 0)), n(answered)).alias("citation_coverage"),
        n(judged).alias("judged_answers"),
        F.round(F.avg(rate), 6).alias("mean_claim_support_rate"),
        n(rate == 1.0).alias("fully_supported_answers"),
    )


def chart_rubric(graded: DataFrame, criteria: tuple[str, ...] = ("chart_type_correct", "trend_direction_correct", "labels_correct")) -> DataFrame:
    """(n, each criterion's count, all_correct)."""
    every = F.lit(True)
    for c in criteria:
        every = every & F.coalesce(F.col(c), F.lit(False))
    return graded.agg(F.count("*").alias("n"), *(F.count_if(F.col(c)).alias(c) for c in criteria), F.count_if(every).alias("all_correct"))


def verification_note(verified: Column, total: Column) -> Column:
    """What must be said under numbers whose labels no one checked; null where all are."""
    some = F.concat(
        verified.cast("string"), F.lit(" of "), total.cast("string"),
        F.lit(" questions were reviewed by a person; the others are machine drafts, so figures that rest on them may move."),
    )
    none = F.lit("Nobody has read these questions over yet: all of them are machine drafts, and the figures may move once some are reviewed.")
    return F.when((total > 0) & (verified >= total), None).when(verified == 0, none).otherwise(some)


def split_counts(entries: DataFrame, splits: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(split, n, verified): every split, with zeros, and unassigned rows apart."""
    spark = entries.sparkSession
    names = spark.createDataFrame([(s,) for s in (*splits, "unassigned")], "split string")
    counts = entries.groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count("*").alias("n"), F.count_if("verified").alias("verified"))
    return names.join(counts, "split", "left").fillna(0)
