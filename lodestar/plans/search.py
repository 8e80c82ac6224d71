"""Retrieval and its metrics: benchmark items are the questions, documents the corpus, item_id the vector's id."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.storage import cut, new_path, small
from lodestar.functions.text import words
from lodestar.operators import evaluation, ivf, lsh, metrics, postings, retrieval
from lodestar.operators.stemming import english
from lodestar.plans.registry import query, table

WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
DEPTHS = (10, 25, 50, 100)
#: Words that make the key of a search for an item's text.
WINDOW = 8


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).join(questions(spark, d).select(F.col("query_id").alias("id")), "id", "left_semi").select("id", "embedding")


def lexical(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    return retrieval.bm25(questions(spark, d), corpus(spark, d), k)


def dense(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    return retrieval.nearest(question_vectors(spark, d), vectors(spark, d), k)


def relevant(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, chunk_id) where the document holds the item's text.

    Such a document has the item's inner words, which white space parts on both sides, in a row; the
    hash of up to eight of them is the key of a join, and the text decides. Items of fewer than three
    words, which have no inner ones, are looked for in every text.
    """
    split = F.array_remove(F.split("text", r"\s+"), "")
    asked = questions(spark, d).withColumnRenamed("text", "item").withColumn("w", F.array_remove(F.split("item", r"\s+"), ""))
    n = F.least(F.size("w") - 2, F.lit(WINDOW))
    items = asked.where(F.size("w") >= 3).select("query_id", "item", n.alias("n"), F.slice("w", F.lit(2), n).alias("inner"))
    items = cut(items.select("query_id", "item", "n", window_key(F.col("inner"), F.lit(0), F.col("n")).alias("key")), "items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # WINDOW values at most
    docs = corpus(spark, d)
    # windows are hashed in the row, so that what is dealt out is an id and a number, not the words around it
    windows = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: window_key(F.col("w"), i, F.lit(n))))
    keys = F.flatten(F.array(*(F.coalesce(windows(n), F.array().cast("array<bigint>")) for n in lengths)).cast("array<array<bigint>>"))
    hits = docs.select("chunk_id", split.alias("w")).select("chunk_id", F.explode(keys).alias("key")).join(small(items.select("query_id", "key")), "key")
    pairs = hits.select("query_id", "chunk_id").distinct().join(small(items.select("query_id", "item")), "query_id")
    found = pairs.join(docs.select("chunk_id", "text"), "chunk_id").where(F.contains("text", F.col("item"))).select("query_id", "chunk_id")
    short = asked.where(F.size("w") < 3).select("query_id", "item")
    if short.isEmpty():
        return found
    return found.unionByName(docs.join(small(short), F.contains("text", F.col("item"))).select("query_id", "chunk_id"))


def window_key(words: Column, at: Column, n: Column) -> Column:
    """A hash of the n words from a place on, at most WINDOW."""
    return F.xxhash64(n, *(F.when(n > k, F.get(words, at + k)) for k in range(WINDOW)))


BM25_SQL = r"""
toks AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
tf AS (SELECT chunk_id, term, len(w) AS dl, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY chunk_id, term, w),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lexical AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
      FROM asked JOIN tf USING (term) JOIN df USING (term), stats GROUP BY query_id, chunk_id))
  WHERE rank <= @LEX@)
"""
KNN_SQL = r"""
dense AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
        round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score
      FROM embeddings q, embeddings c WHERE @WHERE@))
  WHERE rank <= @K@)
"""
ITEM_VECTORS = "q.vec_id IN (SELECT item_id FROM benchmark)"


def bm25_sql(k: int = 50) -> str:
    return BM25_SQL.replace("@LEX@", str(k))


def knn_sql(k: int = 50, where: str = ITEM_VECTORS) -> str:
    return KNN_SQL.replace("@K@", str(k)).replace("@WHERE@", where)


def hybrid_sql(name: str, weight: str, k: int) -> str:
    """A ranking by fusion; weight is SQL for that of the dense list."""
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 9) AS score FROM (
        SELECT query_id, chunk_id, rank, 1::DOUBLE AS w FROM lexical UNION ALL SELECT query_id, chunk_id, rank, {weight}::DOUBLE FROM dense)
      GROUP BY query_id, chunk_id))
  WHERE rank <= {k})
"""


LABEL_SQL = "labels_ AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {knn_sql(10, 'q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id')} SELECT query_id, chunk_id, score, rank FROM dense")
def knn_exact_topk(spark, d):
    v = vectors(spark, d)
    return retrieval.nearest(v.where("id % 20 = 0"), v, 10, exclude_self=True)


@query(f"WITH {knn_sql(10, 'q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND c.label IN (0, 1)')} SELECT query_id, chunk_id, score, rank FROM dense")
def knn_filtered_topk(spark, d):
    v = vectors(spark, d)
    return retrieval.nearest(v.where("id % 20 = 0"), v, 10, {"label": [0, 1]}, exclude_self=True)


@query(f"WITH {bm25_sql()} SELECT query_id, chunk_id, score, rank FROM lexical")
def bm25_topk(spark, d):
    return lexical(spark, d)


@query(
    "WITH "
    + bm25_sql(1_000_000_000)
    + """, kept AS (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM lexical l JOIN documents ON doc_id = chunk_id WHERE lang = 'en')
SELECT query_id, chunk_id, score, r AS rank FROM kept WHERE r <= 20"""
)
def bm25_filtered(spark, d):
    return retrieval.bm25(questions(spark, d), corpus(spark, d), 20, {"lang": "en"})


def stored(spark, d) -> postings.Postings:
    return postings.build(corpus(spark, d), new_path(spark, "postings"), "lang")


@query(f"WITH {bm25_sql()} SELECT query_id, chunk_id, score, rank FROM lexical")
def bm25_stored(spark, d):
    """The same ranking from a stored index."""
    return postings.search(questions(spark, d), stored(spark, d), 50)


@query(
    "WITH "
    + bm25_sql(1_000_000_000)
    + """, kept AS (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM lexical l JOIN documents ON doc_id = chunk_id WHERE lang IN ('fr', 'de'))
SELECT query_id, chunk_id, score, r AS rank FROM kept WHERE r <= 5"""
)
def bm25_stored_filtered(spark, d):
    return postings.search(questions(spark, d), stored(spark, d), 5, {"lang": ["fr", "de"]})


@query(
    f"WITH {bm25_sql()}, {knn_sql()}, {hybrid_sql('fused', '0.25', 10)} SELECT query_id, chunk_id, score, rank, text, source FROM fused JOIN documents ON doc_id = chunk_id"
)
def rrf_hybrid(spark, d):
    found = retrieval.hybrid(lexical(spark, d), dense(spark, d), 10)
    return retrieval.attach(found, corpus(spark, d), "text", "source")


def ranked_lists(spark, d) -> DataFrame:
    """(query_id, retriever, rank, chunk_id) of both retrievers and their fusion. Each ranking is written, and read from there."""
    lex, den = cut(lexical(spark, d), "lexical"), cut(dense(spark, d), "dense")
    fused = retrieval.hybrid(lex, den, 50)
    out = None
    for name, df in (("bm25", lex), ("dense", den), ("hybrid", fused)):
        one = df.where("rank <= 20").select("query_id", F.lit(name).alias("retriever"), "rank", "chunk_id")
        out = one if out is None else out.unionByName(one)
    return out


def scored(spark, d) -> DataFrame:
    names = spark.createDataFrame([("bm25",), ("dense",), ("hybrid",)], "retriever string")
    return metrics.per_query(ranked_lists(spark, d), relevant(spark, d), names)


def metrics_sql(lists: str, names: str) -> str:
    """per_query over lists (query_id, retriever, rank, chunk_id) and names (retriever)."""
    cuts = metrics.CUTS
    recall = ", ".join(f"coalesce(h{k}, 0) / n_relevant AS recall_at_{k}, (coalesce(h{k}, 0) > 0)::INT::DOUBLE AS hit_rate_at_{k}, coalesce(g{k}, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_relevant, {k}) + 1) t(i)) AS ndcg_at_{k}" for k in cuts)
    aggregates = ", ".join(f"count(*) FILTER (rank <= {k})::DOUBLE AS h{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) AS g{k}" for k in cuts)
    return f"""
n_rel AS (SELECT query_id, count(*) AS n_relevant FROM labels_ GROUP BY query_id),
hit AS (SELECT l.*, row_number() OVER (PARTITION BY l.query_id, retriever ORDER BY rank) AS nth FROM {lists} l JOIN labels_ USING (query_id, chunk_id)),
agg AS (SELECT query_id, retriever, min(rank) AS first_rank, sum(nth / rank) AS ap, {aggregates} FROM hit GROUP BY query_id, retriever),
scored AS (SELECT query_id, retriever, n_relevant, first_rank, {recall}, coalesce(1.0::DOUBLE / first_rank, 0) AS mrr, coalesce(ap, 0) / n_relevant AS map
  FROM n_rel CROSS JOIN {names} LEFT JOIN agg USING (query_id, retriever))
"""


THREE = f"""{bm25_sql()}, {knn_sql()}, {hybrid_sql('hybrid', '0.25', 50)},
lists AS (SELECT query_id, 'bm25' AS retriever, rank, chunk_id FROM lexical WHERE rank <= 20 UNION ALL SELECT query_id, 'dense', rank, chunk_id FROM dense WHERE rank <= 20
  UNION ALL SELECT query_id, 'hybrid', rank, chunk_id FROM hybrid WHERE rank <= 20),
names AS (SELECT unnest(['bm25', 'dense', 'hybrid']) AS retriever), {LABEL_SQL}, {metrics_sql('lists', 'names')}"""
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in [f"{n}_at_{k}" for n in ("recall", "hit_rate", "ndcg") for k in metrics.CUTS] + ["mrr", "map"])


@query(f"WITH {THREE} SELECT query_id, retriever, n_relevant, first_rank, round(mrr, 6) AS mrr, round(map, 6) AS map, round(ndcg_at_10, 6) AS ndcg_at_10 FROM scored")
def per_query_rank(spark, d):
    out = scored(spark, d)
    return out.select("query_id", "retriever", "n_relevant", "first_rank", *(F.round(m, 6).alias(m) for m in ("mrr", "map", "ndcg_at_10")))


@query(f"WITH {THREE} SELECT retriever, count(*) AS n_queries, {MEANS} FROM scored GROUP BY retriever")
def metrics_overall(spark, d):
    return metrics.averaged(scored(spark, d))


@query(
    f"""WITH {THREE}, tagged AS (SELECT s.*, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS size, CASE WHEN contains(text, chr(10)) THEN 'lines' ELSE 'line' END AS shape
  FROM scored s JOIN benchmark ON item_id = query_id)
SELECT retriever, 'overall' AS "group", NULL AS value, count(*) AS n_queries, {MEANS} FROM tagged GROUP BY retriever
UNION ALL SELECT retriever, 'size', size, count(*), {MEANS} FROM tagged GROUP BY retriever, size
UNION ALL SELECT retriever, 'shape', shape, count(*), {MEANS} FROM tagged GROUP BY retriever, shape"""
)
def metrics_by_group(spark, d):
    tags = questions(spark, d).select(
        "query_id", F.when(F.length("text") < 200, "short").otherwise("long").alias("size"), F.when(F.contains("text", F.lit("\n")), "lines").otherwise("line").alias("shape")
    )
    return metrics.grouped(scored(spark, d).join(tags, "query_id"), "size", "shape")


@query(
    f"""WITH {THREE}, means AS (SELECT retriever, {MEANS} FROM scored GROUP BY retriever),
long AS (UNPIVOT means ON COLUMNS(* EXCLUDE retriever) INTO NAME metric VALUE value)
SELECT a.retriever, a.metric, round(a.value - b.value, 4) AS delta FROM long a JOIN long b ON a.metric = b.metric AND b.retriever = 'bm25' WHERE a.retriever <> 'bm25'"""
)
def delta_vs_best(spark, d):
    return metrics.deltas(metrics.averaged(scored(spark, d)), "bm25")


def sweep(spark, d) -> DataFrame:
    """Rankings for every dense weight in one job: (query_id, retriever the weight, rank, chunk_id)."""
    both = lexical(spark, d).select("query_id", "chunk_id", "rank", F.lit(True).alias("lex"))
    both = both.unionByName(dense(spark, d).select("query_id", "chunk_id", "rank", F.lit(False).alias("lex")))
    weights = F.array(*map(F.lit, WEIGHTS))
    spread = both.select("*", F.explode(weights).alias("weight"))
    gain = F.when(F.col("lex"), 1.0).otherwise(F.col("weight")) / (retrieval.RRF_K + F.col("rank"))
    sums = spread.groupBy("weight", "query_id", "chunk_id").agg(F.round(F.sum(gain), 9).alias("score"))
    keyed = sums.withColumn("run", F.struct("weight", "query_id"))
    ranked = retrieval.top(keyed, 20, "run")
    return ranked.select("query_id", F.col("weight").cast("string").alias("retriever"), "rank", "chunk_id")


SWEEP_SQL = f"""{bm25_sql()}, {knn_sql()}, names AS (SELECT unnest(['0.0', '0.25', '0.5', '0.75', '1.0']) AS retriever),
lists AS (SELECT * FROM (SELECT query_id, retriever, chunk_id, row_number() OVER (PARTITION BY retriever, query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, retriever, chunk_id, round(sum(w / (60 + rank)), 9) AS score FROM (
    SELECT query_id, chunk_id, rank, retriever, 1::DOUBLE AS w FROM lexical, names UNION ALL SELECT query_id, chunk_id, rank, retriever, retriever::DOUBLE FROM dense, names)
  GROUP BY ALL)) WHERE rank <= 20)"""


@query(f"WITH {SWEEP_SQL}, {LABEL_SQL}, {metrics_sql('lists', 'names')} SELECT retriever, count(*) AS n_queries, {MEANS} FROM scored GROUP BY retriever")
def rrf_weight_sweep(spark, d):
    names = spark.createDataFrame([(str(w),) for w in WEIGHTS], "retriever string")
    return metrics.averaged(metrics.per_query(sweep(spark, d), relevant(spark, d), names))


@query(
    f"""WITH {SWEEP_SQL}, one AS (SELECT query_id, list(chunk_id ORDER BY rank) AS ids FROM lists WHERE retriever = '0.25' GROUP BY query_id),
two AS (SELECT query_id, list(chunk_id ORDER BY rank) AS ids FROM lists WHERE retriever = '1.0' GROUP BY query_id)
SELECT count(*) AS n_queries, count(*) FILTER (one.ids = two.ids) AS same_order, count(*) FILTER (list_sort(one.ids) = list_sort(two.ids)) AS same_members,
  round(avg(len(list_intersect(one.ids, two.ids)) / len(list_distinct(list_concat(one.ids, two.ids)))), 6) AS mean_jaccard FROM one JOIN two USING (query_id)"""
)
def run_agreement(spark, d):
    runs = sweep(spark, d)
    return evaluation.agreement(runs.where("retriever = '0.25'"), runs.where("retriever = '1.0'"))


@query(
    f"""WITH {bm25_sql()}, {knn_sql()}, {hybrid_sql('pool', '0.25', 50)},
one AS (SELECT query_id, list(chunk_id ORDER BY rank) AS ids FROM pool GROUP BY query_id), two AS (SELECT query_id, list(chunk_id ORDER BY rank) AS ids FROM lexical GROUP BY query_id)
SELECT query_id, one.ids = two.ids AS same_order, list_sort(one.ids) = list_sort(two.ids) AS same_members, list_filter(one.ids, lambda x: NOT list_contains(two.ids, x)) AS only_one,
  list_filter(two.ids, lambda x: NOT list_contains(one.ids, x)) AS only_two, 184 AS entry_depth FROM one JOIN two USING (query_id)"""
)
def pool_overlap(spark, d):
    lex = cut(lexical(spark, d), "lexical")
    out = evaluation.divergence(retrieval.hybrid(lex, dense(spark, d), 50), lex)
    return out.withColumn("entry_depth", retrieval.dense_entry_depth(F.lit(0.25)))


@query(
    "WITH "
    + bm25_sql(1_000_000_000)
    + f""", {LABEL_SQL}, kinds AS (SELECT doc_id AS chunk_id, CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 3000 THEN 'middle' ELSE 'long' END AS kind FROM documents),
levels AS (SELECT * FROM (VALUES ('all', ['short', 'middle', 'long']), ('short+middle', ['short', 'middle']), ('middle', ['middle'])) t(retriever, kinds)),
lists AS (SELECT * FROM (SELECT query_id, retriever, chunk_id, row_number() OVER (PARTITION BY retriever, query_id ORDER BY score DESC, chunk_id) AS rank
  FROM lexical JOIN kinds USING (chunk_id) JOIN levels ON list_contains(levels.kinds, kind)) WHERE rank <= 20), names AS (SELECT retriever FROM levels), {metrics_sql('lists', 'names')}
SELECT retriever, count(*) AS n_queries, {MEANS} FROM scored GROUP BY retriever"""
)
def level_ablation(spark, d):
    """Kinds by length stand for the levels of a hierarchy; the allowlists bound what is searched."""
    kind = F.when(F.length("text") < 500, "short").when(F.length("text") < 3000, "middle").otherwise("long")
    levels = {"all": ["short", "middle", "long"], "short+middle": ["short", "middle"], "middle": ["middle"]}
    # a score is the same at each level, so it is worked out once
    scored = retrieval.bm25_scores(questions(spark, d), corpus(spark, d).withColumn("kind", kind), "kind")
    named = F.filter(F.array(*(F.when(F.col("kind").isin(kinds), F.lit(name)) for name, kinds in levels.items())), lambda x: x.isNotNull())
    spread = scored.select("query_id", "chunk_id", "score", F.explode(named).alias("retriever"))
    out = retrieval.top(spread.withColumn("run", F.struct("query_id", "retriever")), 20, "run").select("query_id", "retriever", "rank", "chunk_id")
    return metrics.averaged(metrics.per_query(out, relevant(spark, d), spark.createDataFrame([(n,) for n in levels], "retriever string")))


@cache
def rerank_sql() -> str:
    return f"""WITH {bm25_sql(100)}, words AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark),
scores AS (SELECT l.*, round(len(list_intersect(q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) / len(q), 6) AS s FROM lexical l JOIN words USING (query_id) JOIN documents ON doc_id = chunk_id),
depths AS (SELECT unnest([10, 25, 50, 100]) AS depth)
SELECT * FROM (SELECT query_id, depth, chunk_id, s AS score, score AS retrieval_score, row_number() OVER (PARTITION BY query_id, depth ORDER BY s DESC, chunk_id) AS rank
  FROM scores JOIN depths ON rank <= depth) WHERE rank <= 10"""


@query(rerank_sql())
def rerank_surrogate(spark, d):
    """A share of query words stands for the cross-encoder. A pair is scored once; each depth then ranks its first candidates."""

    def coverage(candidates: DataFrame) -> DataFrame:
        q, t = F.array_distinct(words("question")), F.array_distinct(words("text"))
        asked = questions(spark, d).withColumnRenamed("text", "question").withColumnRenamed("query_id", "q_id")
        joined = candidates.join(asked, F.col("query_id") == F.col("q_id")).join(corpus(spark, d).select("chunk_id", "text"), "chunk_id")
        return joined.withColumn("new_score", F.round(F.size(F.array_intersect(q, t)) / F.size(q), 6)).drop("question", "text", "q_id")

    lex = retrieval.bm25(questions(spark, d), corpus(spark, d), 100)
    new = coverage(lex.withColumnRenamed("score", "retrieval_score"))
    at_depth = new.select("*", F.explode(F.array(*map(F.lit, DEPTHS))).alias("depth")).where("rank <= depth")
    keyed = at_depth.select(F.struct("query_id", "depth").alias("query_id"), "chunk_id", F.col("retrieval_score").alias("score"), "new_score", "rank")
    out = retrieval.rerank(keyed, lambda candidates: candidates, 10)
    return out.select("query_id.query_id", "query_id.depth", "chunk_id", "score", "retrieval_score", "rank")


@query(
    f"""WITH lists AS (SELECT query_id, 'depth ' || depth AS retriever, rank, chunk_id FROM ({rerank_sql()})), names AS (SELECT unnest(['depth 10', 'depth 25', 'depth 50', 'depth 100']) AS retriever),
{LABEL_SQL}, {metrics_sql('lists', 'names')} SELECT retriever, count(*) AS n_queries, {MEANS} FROM scored GROUP BY retriever"""
)
def rerank_depth_metrics(spark, d):
    """What each depth of candidates is worth after reranking."""
    found = rerank_surrogate(spark, d).select("query_id", F.concat(F.lit("depth "), F.col("depth").cast("string")).alias("retriever"), "rank", "chunk_id")
    names = spark.createDataFrame([(f"depth {n}",) for n in DEPTHS], "retriever string")
    return metrics.averaged(metrics.per_query(found, relevant(spark, d), names))


@query()
def bm25_stemmed(spark, d):
    """With stop words and stems, which SQL lacks."""
    return retrieval.bm25(questions(spark, d), corpus(spark, d), 50, analyse=english)


@query()
def knn_lsh(spark, d):
    v = vectors(spark, d)
    return lsh.nearest_approximately(v.where("id % 20 = 0"), v, 10, dims=64, tables=24, bits=4)


def cells(spark, d) -> tuple[DataFrame, ivf.Cells, int]:
    """Queries, a stored index of the vectors, and an ef of three in twenty of them."""
    v = vectors(spark, d)
    index = ivf.build(v, new_path(spark, "cells"))
    return v.where("id % 20 = 0"), index, max(10, v.count() * 3 // 20)


@query()
def knn_ivf(spark, d):
    """The same queries as knn_exact_topk; which cells and codes are near depends on a fit, so SQL can't say."""
    asked, index, ef = cells(spark, d)
    return ivf.nearest_in_cells(asked, index, 10, ef, exclude_self=True)


@query()
def ann_curve(spark, d):
    """Recall against the exact lists by ef, and what a query reads and scores for it."""
    asked, index, ef = cells(spark, d)
    v = vectors(spark, d)
    return ivf.curve(asked, index, retrieval.nearest(asked, v, 10), 10, [10, max(11, ef // 3), max(12, ef)])
