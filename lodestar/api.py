"""The engine's face: ask, search and route over tables of questions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.storage import cut
from lodestar.operators import facts as fact_ops
from lodestar.operators.generation import answers
from lodestar.operators.measurement import identity_problems
from lodestar.operators.retrieval import CANDIDATES, attach, bm25, hybrid, matches, nearest, request_filters, rerank
from lodestar.operators.route import classify
from lodestar.operators.tracing import Trace, problems

MIN_QUESTION, MAX_QUESTION, MOST_ASKED, MOST_SEARCHED = 3, 1000, 20, 50
PASSAGE = ("company", "filing_type", "filing_date", "section", "text")


@dataclass
class Engine:
    """corpus (chunk_id, text, PASSAGE fields, …), vectors (id, embedding), facts; models are functions.

    encode: (DataFrame query_id, text) -> (id, embedding). scorer: see rerank. generate: see answers.
    """

    corpus: DataFrame
    vectors: DataFrame
    facts: DataFrame
    encode: Callable[[DataFrame], DataFrame]
    scorer: Callable[[DataFrame], DataFrame] | None = None
    generate: Callable[[DataFrame], DataFrame] | None = None

    def route(self, questions: DataFrame) -> DataFrame:
        return classify(checked(questions))

    def search(self, questions: DataFrame, k: int = 10, filters: Mapping[str, object] | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank, fields) of the hybrid search, reranked if there is a scorer.

        filters bound both lists by fields of the corpus; vectors need not have these.
        """
        if not 1 <= k <= MOST_SEARCHED:
            raise ValueError(f"k must be from 1 to {MOST_SEARCHED}")
        asked = checked(questions).select("query_id", F.col("question").alias("text"))
        lexical = bm25(asked, self.corpus, CANDIDATES, filters)
        vectors = self.vectors
        if filters:
            vectors = vectors.join(self.corpus.where(matches(filters)).select(F.col("chunk_id").alias("id")), "id", "left_semi")
        dense = nearest(self.encode(asked), vectors, CANDIDATES)
        found = hybrid(lexical, dense, CANDIDATES if self.scorer else k)
        if self.scorer:
            found = rerank(found, lambda c: self.scorer(attach(c.join(asked.withColumnRenamed("text", "question"), "query_id"), self.corpus, "text")), k)
            found = found.select("query_id", "chunk_id", "score", "rank")
        return attach(found, self.corpus, *PASSAGE)

    def ask(self, questions: DataFrame, k: int = 6, company: str | None = None, filing_type: str | None = None, trace: Trace | None = None) -> DataFrame:
        """Each question with its route and answer. The route's facts come first; a miss falls through to the search.

        company (in either case) and filing_type bound the search; empty ones don't. trace gets the counts of routes, hits and
        refusals, and the times of routing and search; what runs the answer is to be in a span of its own.
        """
        if not 1 <= k <= MOST_ASKED:
            raise ValueError(f"k must be from 1 to {MOST_ASKED}")
        span = trace.span if trace else lambda name: nullcontext()
        watch = trace.watch if trace else lambda df, name, **counts: df
        with span("route"):
            routed = watch(self.route(questions), "route", **{r: F.count_if(F.col("route") == r) for r in ("structured", "semantic")})
            routed = cut(routed, "routed")  # three branches read it
        wanted = routed.where("route = 'structured'")
        found = fact_ops.lookup(wanted, self.facts).where("n_facts > 0").withColumn("formatted_value", fact_ops.formatted())
        told = F.concat("concept", F.lit(" of "), "company", F.lit(" for "), F.col("fiscal_year").cast("string"), F.lit(": "), "formatted_value")
        exact = found.select("query_id", F.lit("structured").alias("route"), told.alias("answer"), F.array("source_url").alias("sources"), F.lit(False).alias("refused"))
        rest = routed.join(found.select("query_id"), "query_id", "left_anti")
        with span("search"):
            hits = watch(self.search(rest, k, request_filters(company, filing_type)), "search", hits=F.count("*"))
        passages = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *PASSAGE, "chunk_id"))), lambda x: x.dropFields("rank")).alias("passages"))
        written = answers(rest.join(passages, "query_id", "left"), self.generate)
        said = written.select("query_id", F.lit("semantic").alias("route"), "answer", F.transform("citations", lambda c: c["chunk_id"].cast("string")).alias("sources"), "refused")
        out = exact.unionByName(said)
        return watch(out, "answers", answered=F.count("*"), structured=F.count_if(F.col("route") == "structured"), refused=F.count_if("refused"))

    def health(self) -> dict[str, object]:
        """Whether the session answers at all; nothing is read."""
        try:
            return {"status": "ok", "spark": self.corpus.sparkSession.range(1).count() == 1}
        except Exception as e:
            return {"status": "down", "spark": False, "error": f"{type(e).__name__}: {e}".split("\n")[0][:200]}

    def ready(self, expected: Mapping[str, object] | None = None, reported: Mapping[str, object] | None = None) -> dict[str, object]:
        """Whether questions can be answered: a row of each table can be read, and what is served is what was asked for; with the reasons if not."""
        found = problems({"corpus": self.corpus, "vectors": self.vectors, "facts": self.facts})
        wrong = identity_problems(expected or {}, reported or {})
        return {"ready": not found and not wrong, "tables": found, "identity": wrong}


def checked(questions: DataFrame) -> DataFrame:
    """questions (query_id, question); one of a length out of bounds is an error."""
    fits = F.length("question").between(MIN_QUESTION, MAX_QUESTION)
    return questions.withColumn("question", F.when(fits, F.col("question")).otherwise(F.raise_error(F.lit("a question must have 3 to 1000 characters"))))
