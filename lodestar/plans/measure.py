"""ANN curves, vector checks, parity of indexes and runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import evaluation, measurement, retrieval, tracking
from lodestar.plans.registry import query, table
from lodestar.plans.search import knn_sql, vectors

HALF_SQL = "round(list_sum(list_transform(list_zip(q.embedding[1:32], c.embedding[1:32]), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6)"


def exact(spark, d):
    v = vectors(spark, d)
    return retrieval.nearest(v.where("id % 20 = 0"), v, 10)


def halved(spark, d):
    """An approximation that SQL can follow: half of the dimensions."""
    v = vectors(spark, d).withColumn("embedding", F.slice("embedding", 1, 32))
    return retrieval.nearest(v.where("id % 20 = 0"), v, 10)


BOTH_SQL = f"""{knn_sql(10, 'q.vec_id % 20 = 0')},
half AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {HALF_SQL} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)) WHERE rank <= 10)"""


@query(
    f"""WITH {BOTH_SQL} SELECT d.query_id, count(h.chunk_id) / count(*) AS recall FROM dense d LEFT JOIN half h ON d.query_id = h.query_id AND d.chunk_id = h.chunk_id GROUP BY d.query_id"""
)
def ann_recall(spark, d):
    return measurement.ann_recall(exact(spark, d), halved(spark, d), 10)


@query(
    f"""WITH {BOTH_SQL}, cuts AS (SELECT query_id, min(score) AS cut FROM dense GROUP BY query_id),
same AS (SELECT query_id, bool_and(coalesce(d.chunk_id = h.chunk_id, false)) AS same, bool_and(coalesce(abs(d.score - h.score) <= 1e-6, false)) AS scores FROM dense d FULL JOIN half h USING (query_id, rank) GROUP BY query_id),
alone AS (SELECT query_id, score FROM dense WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM half) UNION ALL SELECT query_id, score FROM half WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM dense)),
odd AS (SELECT query_id, bool_and(abs(score - cut) <= 1e-6) AS at_cut FROM alone JOIN cuts USING (query_id) GROUP BY query_id)
SELECT CASE WHEN same THEN 'identical' WHEN scores AND coalesce(at_cut, true) THEN 'tied' ELSE 'different' END AS verdict, count(*) AS n FROM same LEFT JOIN odd USING (query_id) GROUP BY verdict"""
)
def list_verdicts(spark, d):
    return measurement.verdict_counts(measurement.list_verdicts(exact(spark, d), halved(spark, d)))


@query(
    """WITH c AS (SELECT event_type AS k, CASE WHEN user_id % 6 > 0 THEN (user_id % 6 * 50)::INT END AS ef, round(0.985 + 0.01 * (user_id % 6) / 6 + 0.01 * (count(*) FILTER (value > 60) / count(*)), 6) AS recall, round(avg(value), 6) AS p95 FROM events GROUP BY event_type, user_id % 6),
r AS (SELECT *, bool_or(recall >= 0.99) OVER (PARTITION BY k) AS met FROM c)
SELECT k, ef, recall, p95, met FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN met THEN (recall < 0.99)::INT ELSE 0 END, CASE WHEN met THEN 0 ELSE -recall END, p95, coalesce(ef, 0)) AS i FROM r) WHERE i = 1"""
)
def operating_point(spark, d):
    """A curve for each type of event: users by six settings of the knob, their values as times."""
    setting = F.col("user_id") % 6
    by = table(spark, d, "events").groupBy(F.col("event_type").alias("k"), setting.alias("setting")).agg(F.count_if(F.col("value") > 60).alias("far"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("p95"))
    recall = F.round(0.985 + 0.01 * F.col("setting") / 6 + 0.01 * (F.col("far") / F.col("n")), 6)
    curve = by.select("k", F.when(F.col("setting") > 0, (F.col("setting") * 50).cast("int")).alias("ef"), recall.alias("recall"), "p95")
    return measurement.operating_point(curve, "k")


@query(
    """WITH a AS (SELECT user_id AS id, list_sort(list_distinct(list_filter(list((event_id % 60)::INT), lambda x: x >= 10))) AS p FROM events GROUP BY user_id)
SELECT id, pos, point FROM (SELECT id, 0 AS pos, NULL::INT AS point FROM a UNION ALL SELECT id, unnest(range(1, len(p) + 1))::INT, unnest(p) FROM a)"""
)
def search_points(spark, d):
    """The settings that a user's events ask for."""
    asked = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_list((F.col("event_id") % 60).cast("int")).alias("asked"))
    return asked.select("id", F.posexplode(measurement.search_points("asked", 10)).alias("pos", "point"))


@query(
    """WITH v AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, round(list_avg(v), 6) AS mean, v[greatest(1, least(n, round_even(0.5::DOUBLE * n, 0)))::INT] AS p50, v[greatest(1, least(n, round_even(0.95::DOUBLE * n, 0)))::INT] AS p95, n FROM v"""
)
def latency_summary(spark, d):
    return measurement.latency_summary(table(spark, d, "events"), "event_type", value="value")


NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(f"SELECT count(*) AS n, round(max(abs({NORM} - 1)), 6) AS max_error, max(abs({NORM} - 1)) <= 1e-3 AS ok FROM embeddings")
def vector_norms(spark, d):
    return measurement.norm_error(vectors(spark, d))


@query(
    """WITH c AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(embedding, lambda x: round(x::DOUBLE, 2)) AS b FROM embeddings),
s AS (SELECT list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS s FROM c) SELECT count(*) AS n, round(avg(s), 6) AS mean_cosine, round(min(s), 6) AS min_cosine FROM s"""
)
def vector_fidelity(spark, d):
    v = vectors(spark, d)
    rounded = v.select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("embedding"))
    return measurement.fidelity(v, rounded)


@query(f"SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_dims, round(max(abs({NORM} - 1)), 6) AS max_norm_error, count(*) FILTER (len(embedding) <> 64) = 0 AND max(abs({NORM} - 1)) <= 1e-3 AS ok FROM embeddings")
def encoder_contract(spark, d):
    return measurement.contract(vectors(spark, d), 64)


TWO_SQL = "two AS (SELECT doc_id, lang FROM documents WHERE lang <> 'fr' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"


def thinned(spark, d):
    marks = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").where("lang <> 'fr'").join(marks, "doc_id", "left_anti").select("doc_id", "lang")


@query(f"WITH {TWO_SQL}, a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), b AS (SELECT lang, count(*) AS n FROM two GROUP BY lang) SELECT lang, a.n AS n_one, coalesce(b.n, 0) AS n_two FROM a LEFT JOIN b USING (lang) WHERE a.n <> coalesce(b.n, 0)")
def parity_counts(spark, d):
    return measurement.count_problems(table(spark, d, "documents").select("doc_id", "lang"), thinned(spark, d), "lang")


@query(f"WITH {TWO_SQL} SELECT 'one' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM two)")
def parity_ids(spark, d):
    return measurement.coverage_problems(table(spark, d, "documents").select("doc_id"), thinned(spark, d), "doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def parity_samples(spark, d):
    return measurement.sample_ids(table(spark, d, "documents"), "source", "doc_id", 5)


@query(
    """WITH s AS (SELECT 'l' || label AS "index", vec_id AS chunk_id, list_dot_product(embedding, embedding)::DOUBLE AS own, abs(embedding[1])::DOUBLE AS other FROM embeddings)
SELECT "index", count(*) AS n, count(*) FILTER (own < 0.999 OR other > 0.99) AS bad, count(*) > 0 AND count(*) FILTER (own < 0.999 OR other > 0.99) = 0 AS ok FROM s GROUP BY "index" """
)
def provenance(spark, d):
    from lodestar.functions.vectors import dot

    v = vectors(spark, d)
    s = v.select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("index"), F.col("id").alias("chunk_id"), dot("embedding", "embedding").alias("own"), F.abs(F.get("embedding", 0)).cast("double").alias("other"))
    return measurement.provenance_problems(s)


@query(
    """WITH r AS (SELECT 'u' || user_id AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at, CASE event_type WHEN 'purchase' THEN 'finished' ELSE 'failed' END AS state, event_id FROM events)
SELECT name, created_at, state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, event_id) AS i FROM r WHERE state = 'finished') WHERE i = 1"""
)
def latest_runs(spark, d):
    e = table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.when(F.col("event_type") == "purchase", "finished").otherwise("failed").alias("state"), "event_id",
    )
    return tracking.latest_runs(e)


METRICS_SQL = """a AS (SELECT c_mktsegment AS run, c_custkey AS metric, c_acctbal AS value FROM customer WHERE c_nationkey <> 3), b AS (SELECT c_mktsegment AS run, c_custkey AS metric, CASE WHEN c_nationkey = 5 THEN c_acctbal + 1 ELSE c_acctbal END AS value FROM customer WHERE c_nationkey <> 4)"""


@query(
    f"""WITH {METRICS_SQL}, f AS (SELECT coalesce(a.run, b.run) AS run, a.value AS x, b.value AS y, a.metric IS NOT NULL AS ia, b.metric IS NOT NULL AS ib FROM a FULL JOIN b ON a.run = b.run AND a.metric = b.metric)
SELECT run, count(*) FILTER (ia AND ib) AS shared, count(*) FILTER (ia AND ib AND abs(x - y) > 1e-9) AS mismatched, count(*) FILTER (NOT ia) AS missing_one, count(*) FILTER (NOT ib) AS missing_two,
  count(*) FILTER (ia AND ib) > 0 AND count(*) FILTER (NOT ia OR NOT ib OR abs(x - y) > 1e-9) = 0 AS ok FROM f GROUP BY run"""
)
def metric_compare(spark, d):
    c = table(spark, d, "customer")
    one = c.where("c_nationkey <> 3").select(F.col("c_mktsegment").alias("run"), F.col("c_custkey").alias("metric"), F.col("c_acctbal").alias("value"))
    two = c.where("c_nationkey <> 4").select(F.col("c_mktsegment").alias("run"), F.col("c_custkey").alias("metric"), F.when(F.col("c_nationkey") == 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("value"))
    return tracking.compared(one, two, "run")


@query("SELECT n_name AS name, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9900) AS found FROM nation")
def verify_runs(spark, d):
    rich = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    n = table(spark, d, "nation")
    have = n.join(rich, n["n_nationkey"] == rich["n_nationkey"].cast("int"), "left_semi").select(F.col("n_name").alias("name"))
    return tracking.verified_runs(n.select(F.col("n_name").alias("name")), have)


@query(
    """WITH e AS (SELECT unnest([10.0, 50.0, 100.0, 'Infinity'::DOUBLE]) AS le) SELECT le, (SELECT count(*) FROM events WHERE value <= le) AS n FROM e"""
)
def latency_histogram(spark, d):
    return tracking.histogram(table(spark, d, "events"), "value", (10.0, 50.0, 100.0))


@query(
    """WITH a AS (SELECT doc_id AS query_id, lang, quality::DOUBLE AS m1, toxic::DOUBLE AS m2 FROM labels JOIN documents USING (doc_id)), b AS (SELECT doc_id AS query_id, (n_chars > 1000)::INT::DOUBLE AS m1, (n_chars % 2)::DOUBLE AS m2 FROM documents WHERE source <> 'src3'),
l AS (SELECT lang, 'm1' AS metric, a.m1 AS x, b.m1 AS y FROM a JOIN b USING (query_id) UNION ALL SELECT lang, 'm2', a.m2, b.m2 FROM a JOIN b USING (query_id))
SELECT lang, metric, count(*) AS n, round(avg(x), 4) AS base, round(avg(y), 4) AS candidate, round(avg(y) - avg(x), 4) AS delta FROM l GROUP BY lang, metric"""
)
def compare_groups(spark, d):
    docs = table(spark, d, "documents")
    a = table(spark, d, "labels").join(docs.select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("query_id"), "lang", F.col("quality").cast("double").alias("m1"), F.col("toxic").cast("double").alias("m2"))
    b = docs.where("source <> 'src3'").select(F.col("doc_id").alias("query_id"), (F.col("n_chars") > 1000).cast("double").alias("m1"), (F.col("n_chars") % 2).cast("double").alias("m2"))
    return evaluation.compared_groups(a, b, "lang", ["m1", "m2"])


@query("SELECT doc_id, n_chars FROM documents EXCEPT ALL SELECT doc_id, n_chars FROM documents JOIN labels USING (doc_id)")
def arm_differences(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return evaluation.unmatched(docs, docs.join(table(spark, d, "labels").select("doc_id"), "doc_id"), "doc_id", "n_chars")


@query("SELECT item_id AS query_id, 1.0 * item_id AS value, item_id % 7 <> 0 AND item_id % 5 <> 0 AS exact FROM benchmark")
def exact_values(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").cast("double").alias("value"))
    expected = b.select("query_id", F.when(F.col("query_id") % 7 == 0, F.col("value") + 1).when(F.col("query_id") % 5 == 0, None).otherwise(F.col("value") + 0.5).alias("expected_value"))
    return evaluation.exact_values(expected, b)


@query(
    """WITH r AS (SELECT user_id AS run, json_object('n', count(*), 'stats', json_object('mean', avg(value), 'most', max(value), 'ok', true), 'values', list(value ORDER BY event_id), 'per_query', [1, 2],
  'last', json_object('type', arg_max(event_type, event_id), 'points', [json_object('id', max(event_id)), json_object('id', min(event_id))])) AS report FROM events GROUP BY user_id)
SELECT run, replace(replace(replace(fullkey, '$.', ''), '[', '.'), ']', '') AS metric, round(atom::DOUBLE, 6) AS value
FROM r, json_tree(report) WHERE type IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND fullkey NOT LIKE '$.per_query%' AND NOT regexp_matches(fullkey, '^\\$\\.values\\[\\d{3,}\\]$')"""
)
def flatten_reports(spark, d):
    """A report of each user's events as JSON, and its numbers again."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])  # some events a user
    point = lambda f: F.struct(f("event_id").alias("id"))
    report = F.struct(
        F.count("*").alias("n"), F.struct(F.avg("value").alias("mean"), F.max("value").alias("most"), F.lit(True).alias("ok")).alias("stats"), values.alias("values"),
        F.array(F.lit(1), F.lit(2)).alias("per_query"), F.struct(F.max_by("event_type", "event_id").alias("type"), F.array(point(F.max), point(F.min)).alias("points")).alias("last"),
    )
    reports = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.to_json(report).alias("report"))
    out = tracking.flatten_reports(reports, "run")
    return out.select("run", "metric", F.round("value", 6).alias("value"))


@query(
    """WITH e AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events),
s AS (SELECT unnest([0.0, 0.01, 0.5, 0.9, 0.999, 1.0])::DOUBLE AS share)
SELECT event_type, share, value, n FROM e, s WHERE i = greatest(1, least(n, round_even(share * n, 0)))"""
)
def percentile_ranks(spark, d):
    return measurement.percentiles(table(spark, d, "events"), (0.0, 0.01, 0.5, 0.9, 0.999, 1.0), "event_type", value="value")
