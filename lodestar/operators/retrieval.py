"""Set-at-a-time retrieval: queries are a table, results are (query_id, chunk_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.storage import cut, small
from lodestar.functions.text import words
from lodestar.functions.vectors import matrix

#: The constants of reciprocal rank fusion, of the hybrid search and of BM25.
RRF_K, LEXICAL_WEIGHT, DENSE_WEIGHT, CANDIDATES = 60, 1.0, 0.25, 50
K1, B = 1.2, 0.75
#: Bytes of query vectors that are sent to all workers at most, and what a cell holds where there are more.
QUERY_BYTES = 64_000_000
CELL_ROWS, CELL_QUERIES = 50_000, 5_000
#: Pairs of a document and a query, or a query term, that a task of BM25 holds, some; and query terms that a text has, some.
TASK_PAIRS, TEXT_TERMS = 2_000_000, 100
#: Hits of all queries that a task holds at most where queries are sent to it.
QUERY_HITS = 2_000_000
#: Hits that a task holds beside the best k of each query before it drops the others, scores and vectors that it works on at a time.
HELD_ROWS, BLOCK_SCORES, BLOCK_WIDTH, BATCH_ROWS = 100_000, 1 << 20, 1 << 10, 10_000


def matches(filters: Mapping[str, object] | None) -> Column:
    """Equality for a scalar, membership for a collection, all of them; true without filters."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set, frozenset)) else F.col(c) == v for c, v in (filters or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def request_filters(company: str | None = None, filing_type: str | None = None) -> dict[str, str]:
    return {k: v for k, v in {"company": company.upper() if company else None, "filing_type": filing_type}.items() if v}


def top(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query by score, ties by chunk_id; ranks from 1. Spark limits groups before the shuffle."""
    best = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


class Best:
    """The k best of each query so far, by score and then id, in memory bounded by the queries.

    Scores are worked out for BLOCK_SCORES pairs at a time, and only those that reach a query's k-th are held. With codes, (code a table) of
    queries and vectors, pairs count that have the code of some table in common.
    """

    def __init__(self, ids: np.ndarray, asked: np.ndarray, k: int, exclude_self: bool, digits: int, codes: np.ndarray | None = None):
        self.ids, self.asked, self.k, self.exclude_self, self.digits, self.codes = ids, asked, k, exclude_self, digits, codes
        self.held, self.new, self.size = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], [], 0
        self.least = np.full(len(ids), -np.inf)

    def add(self, own: np.ndarray, rows: np.ndarray, codes: np.ndarray | None = None) -> None:
        high = BLOCK_SCORES // BLOCK_WIDTH
        some = self.k + self.exclude_self
        for c in range(0, len(rows), BLOCK_WIDTH):
            for a in range(0, len(self.ids), high):
                scores = self.asked[a : a + high] @ rows[c : c + BLOCK_WIDTH].T
                least = self.least[a : a + high, None]
                if self.codes is None and scores.shape[1] > some and np.isinf(least).any():
                    least = np.maximum(least, np.partition(scores, -some, axis=1)[:, -some, None])
                # all that may tie with the k-th when rounded, so that ids decide later
                q, r = np.nonzero(scores >= least - 10.0**-self.digits)
                score, q, r = np.round(scores[q, r], self.digits), q + a, r + c
                fits = score >= self.least[q]
                if self.exclude_self:
                    fits &= own[r] != self.ids[q]
                if self.codes is not None:
                    shared = np.zeros(len(q), bool)
                    for t in range(codes.shape[1]):
                        shared |= self.codes[q, t] == codes[r, t]
                    fits &= shared
                self.new.append([q[fits], own[r[fits]], score[fits]])
                self.size += int(fits.sum())
                if self.size > max(HELD_ROWS, len(self.held[0])):
                    self.cut()

    def cut(self) -> None:
        q, own, score = (np.concatenate(c) for c in zip(self.held, *self.new, strict=True))
        order = np.lexsort((own, -score, q))
        first = np.flatnonzero(np.concatenate([[True], np.diff(q[order]) != 0])) if len(order) else order
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.held, self.new, self.size = [c[order[place < self.k]] for c in (q, own, score)], [], 0
        last = order[place == self.k - 1]
        self.least[q[last]] = score[last]

    def columns(self) -> list[np.ndarray]:
        """query_id, chunk_id, score."""
        self.cut()
        return [self.ids[self.held[0]], *self.held[1:]]


def nearest_in_batches(held, k: int, exclude_self: bool, digits: int, codes: Callable[[np.ndarray], np.ndarray] | None = None):
    """held has the queries' ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = held.value
        best = Best(ids, asked, k, exclude_self, digits, codes and codes(asked))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                rows = matrix(part.column(1), asked.shape[1])
                best.add(part.column(0).to_numpy(zero_copy_only=False), rows, codes and codes(rows))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.columns()], ["query_id", "chunk_id", "score"])

    return run


def nearest_in_cells(k: int, exclude_self: bool, digits: int, codes: Callable[[np.ndarray], np.ndarray] | None = None):
    """cogroup function: vectors and queries of a cell -> the k best of each query there."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "chunk_id", "score"]
        if not vectors.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        held = SimpleNamespace(value=block_of(queries))
        batches = nearest_in_batches(held, k, exclude_self, digits, codes)(iter(vectors.select(["id", "embedding"]).to_batches()))
        return pa.Table.from_batches(batches)

    return run


def block_of(queries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a table of queries."""
    return queries.column("id").to_numpy(), matrix(queries.column("embedding").combine_chunks())


def nearest(queries: DataFrame, corpus: DataFrame, k: int, filters: Mapping[str, object] | None = None, exclude_self: bool = False, digits: int = 6, codes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Exact k-NN by cosine of unit vectors: queries and corpus are (id long, embedding).

    Filters apply before the search, so k results meet them. Queries of QUERY_BYTES and QUERY_HITS at most are sent to where the vectors are read;
    more are dealt with the vectors into cells of bounded size, in which each query meets each vector once. A task or cell hands
    on k rows a query. Vectors of another width, or with null elements, are an error; scores are rounded first, so that equal vectors tie.
    With codes, a function of vectors to a row of codes each, a query meets the vectors that have some code in common with it, column by column.
    """
    spark = corpus.sparkSession
    rows = corpus.where(matches(filters)).where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
    asked = queries.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
    schema = "query_id long, chunk_id long, score double"
    n, size = asked.agg(F.count("*"), F.sum(8 * F.size("embedding"))).first()
    if not n:
        return top(spark.createDataFrame([], schema), k)
    if size <= QUERY_BYTES and n * k <= QUERY_HITS:
        held = spark.sparkContext.broadcast(block_of(asked.toArrow()))
        return top(rows.mapInArrow(nearest_in_batches(held, k, exclude_self, digits, codes), schema), k)
    parts, sides = (-(-c // most) or 1 for c, most in ((rows.count(), CELL_ROWS), (n, CELL_QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part, side = (F.pmod(F.xxhash64("id"), F.lit(c)).cast("int") for c in (parts, sides))
    dealt = rows.select(part.alias("part"), every(sides).alias("side"), "id", "embedding").groupBy("part", "side")
    asks = asked.select(every(parts).alias("part"), side.alias("side"), "id", "embedding").groupBy("part", "side")
    return top(dealt.cogroup(asks).applyInArrow(nearest_in_cells(k, exclude_self, digits, codes), schema), k)


def bm25(queries: DataFrame, corpus: DataFrame, k: int, filters: Mapping[str, object] | None = None, analyse: Callable[[Column], Column] = words) -> DataFrame:
    """Okapi BM25: queries (query_id, text), corpus (chunk_id, text, ...). Distinct query terms, exact lengths.

    Filters bound what is returned and, like the statistics, don't change scores.
    """
    scored = bm25_scores(queries, corpus.withColumn("meets", matches(filters)), "meets", analyse=analyse)
    return top(scored.where("meets").drop("meets"), k)


def bm25_scores(queries: DataFrame, corpus: DataFrame, *fields: str, analyse: Callable[[Column], Column] = words) -> DataFrame:
    """(query_id, chunk_id, fields, score) of all documents with a query term.

    Texts are read and analysed once: occurrences of query terms and a row a document for the statistics are dealt by document and
    counted, and all else reads these counts. Tasks get so many documents that the pairs with queries are some TASK_PAIRS in each,
    however large the corpus.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(analyse(F.col("text")))).alias("term"))
    terms = cut(asked, "asked")
    vocabulary = small(terms.select("term", F.lit(True).alias("asked")).distinct())
    n_queries, n_terms = terms.agg(F.count_distinct("query_id"), F.count_distinct("term")).first()
    parts = max(corpus.sparkSession.sparkContext.defaultParallelism, corpus.count() * (n_queries + min(n_terms, TEXT_TERMS)) // TASK_PAIRS + 1)
    docs = corpus.select("chunk_id", *fields, analyse(F.col("text")).alias("terms")).withColumn("dl", F.size("terms"))
    each = docs.select("chunk_id", *fields, "dl", F.posexplode_outer("terms").alias("i", "term")).join(vocabulary, "term", "left")
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    each = each.where(first | F.col("asked")).select("chunk_id", *fields, "dl", first.alias("first"), F.when(F.col("asked"), F.col("term")).alias("term"))
    by_document = each.repartition(parts, "chunk_id").groupBy("chunk_id", *fields, "dl", "term")
    counts = cut(by_document.agg(F.count("*").alias("tf"), F.count_if("first").alias("docs")), "counts")
    n, words_in, with_words = counts.agg(F.sum("docs"), F.sum(F.col("docs") * F.col("dl")), F.sum(F.when(F.col("dl").isNotNull(), F.col("docs")))).first()
    avgdl = float(words_in) / with_words if with_words else None
    found = counts.where("term is not null").drop("docs")
    df = found.select("term", "chunk_id").repartition(parts, "chunk_id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = small(terms.join(df, "term").select("query_id", "term", idf.alias("idf")))
    # a document's scores are added up where its counts lie
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    impact = found.repartition(parts, "chunk_id").join(weights, "term").select("query_id", "chunk_id", *fields, (F.col("idf") * weight).alias("impact"))
    return impact.groupBy("query_id", "chunk_id", *fields).agg(F.round(F.sum("impact"), 6).alias("score"))


def fuse(ranked: DataFrame, weights: Mapping[str, float], k: int | None = None, rank_constant: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, retriever, chunk_id, rank); a retriever without a weight is an error."""
    table = F.create_map(*(x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))))
    weight = F.coalesce(F.try_element_at(table, F.col("retriever")), F.raise_error(F.concat(F.lit("no weight for retriever "), "retriever")).cast("double"))
    scored = ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (rank_constant + F.col("rank"))), 9).alias("score"))
    return top(scored, k if k is not None else 1 << 30)


def hybrid(lexical: DataFrame, dense: DataFrame, k: int, candidates: int = CANDIDATES, lexical_weight: float = LEXICAL_WEIGHT, dense_weight: float = DENSE_WEIGHT) -> DataFrame:
    """Both rankings cut to candidates, then fused. (query_id, chunk_id, score, rank)"""
    both = lexical.where(F.col("rank") <= candidates).select("query_id", F.lit("lexical").alias("retriever"), "chunk_id", "rank")
    both = both.unionByName(dense.where(F.col("rank") <= candidates).select("query_id", F.lit("dense").alias("retriever"), "chunk_id", "rank"))
    return fuse(both, {"lexical": lexical_weight, "dense": dense_weight}, k)


def rerank(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame], k: int | None = None) -> DataFrame:
    """candidates (query_id, chunk_id, score, ...) in the order of scorer's new_score; k of 0 or None keeps all."""
    scored = scorer(candidates.withColumnRenamed("score", "retrieval_score")).withColumnRenamed("new_score", "score")
    return top(scored.drop("rank"), k or 1 << 30)


def dense_entry_depth(weight: Column, rank_constant: int = RRF_K) -> Column:
    """The lexical depth from which a dense-only document at rank 1 could enter; 0 without a weight."""
    return F.when(weight <= 0, 0).otherwise((F.lit(rank_constant + 1) / weight).cast("int") - rank_constant)


def attach(hits: DataFrame, corpus: DataFrame, *fields: str) -> DataFrame:
    """Fields of the corpus for hits, joined last so that ranking never carries text. Embeddings are not among them."""
    return hits.join(corpus.select("chunk_id", *fields), "chunk_id")
