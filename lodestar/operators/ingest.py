"""From filings' pages to chunks: one parse a page for each kind of chunk, errors as rows, never as a failed job."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.ids import chunk_id, token_count
from lodestar.operators.html import chart_refs, html_leaves, html_tables
from lodestar.operators.structure import FILING, document_chunks, filing_chunks
from lodestar.operators.tables import table_chunks


@dataclass
class Ingested:
    chunks: DataFrame
    tables: DataFrame
    errors: DataFrame

    def counts(self) -> DataFrame:
        """(company, chunk_type, n)."""
        kinds = self.chunks.select("company", "chunk_type").unionByName(self.tables.select("company", "chunk_type"))
        return kinds.groupBy("company", "chunk_type").agg(F.count("*").alias("n"))


def ingest(filings: DataFrame) -> Ingested:
    """filings (FILING columns, html). A page that can't be parsed is among errors, and has its document chunk alone."""
    pages = filings.select("accession_number", "html")
    leaves = html_leaves(pages, "html", "accession_number")
    grids = html_tables(pages, "html", "accession_number")
    plain = filings.select(*FILING)
    errors = leaves.where("error is not null").select("accession_number", "error").unionByName(grids.where("error is not null").select("accession_number", "error"))
    good = leaves.where("error is null").select("accession_number", "idx", "text")
    tables = table_chunks(grids.where("error is null").select("accession_number", "table_index", "rows"), document_chunks(plain))
    return Ingested(filing_chunks(plain, good), tables, errors.distinct())


def chart_chunks(filings: DataFrame, describe: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """Chunks of chart descriptions. describe adds description to (…, image_url, alt_text, mime), null where it failed.

    Images whose url known (source_url) has are skipped, but count in chunk_index.
    """
    refs = chart_refs(filings, "html", "source_url", *FILING).where("error is null")
    if known is not None:
        refs = refs.join(known.select(F.col("source_url").alias("image_url")), "image_url", "left_anti")
    told = describe(refs).where("description is not null")
    parents = document_chunks(filings.select(*FILING)).select("accession_number", F.col("chunk_id").alias("parent_chunk_id"))
    out = told.join(parents, "accession_number").select(
        *(F.col("image_url").alias(c) if c == "source_url" else F.col(c) for c in FILING), F.lit("chart_description").alias("chunk_type"), F.lit(1).alias("hierarchy_level"),
        "parent_chunk_id", F.col("ref_index").alias("chunk_index"), F.lit(None).cast("string").alias("section"), F.col("description").alias("text"),
    )
    return out.withColumns({"chunk_id": chunk_id(), "token_count": token_count("text")})


def retried(call: Callable, attempts: int = 3, wait: float = 15.0, transient: Callable[[Exception], bool] = lambda e: "429" in str(e), sleep=time.sleep):
    """call, tried again after transient failures; wait doubles."""

    def run(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception as e:
                if n + 1 == attempts or not transient(e):
                    raise
                sleep(wait * 2**n)

    return run


def draft_entries(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions (eval_id, question, question_type, chunk_ids) as eval entries labelled by those chunks, unverified."""
    labels = questions.select("eval_id", F.posexplode("chunk_ids").alias("n", "chunk_id")).join(chunks.select("chunk_id", *FILING[:3], "chunk_type", "source_url"), "chunk_id")
    rest = ["company", "filing_type", "filing_date", "chunk_type", "source_url"]
    by = labels.groupBy("eval_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]).alias("relevant_chunk_ids"), F.min_by(F.struct(*rest), "n").alias("f")
    )
    out = questions.drop("chunk_ids").join(by, "eval_id")
    return out.select("eval_id", "question", "relevant_chunk_ids", "question_type", *(F.col(f"f.{c}").alias(c) for c in rest), F.lit(False).alias("verified"), F.lit(None).cast("string").alias("split"))
