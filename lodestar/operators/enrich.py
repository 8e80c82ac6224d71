"""Placeholder chunks filled from their children, and what goes into an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import strip
from lodestar.operators.resume import new_rows

#: The budget of a rollup, and the least length of an indexed text.
ROLLUP, MIN_INDEXED = 2000, 20


def rollup(children: DataFrame, parent: str, order: str, text: str = "text", limit: int = ROLLUP) -> DataFrame:
    """(parent, rolled): whole stripped texts in order, joined by blank lines, as many as fit; the first always does.

    The kept texts are a prefix, so a running sum decides each: one shuffle by parent. What is
    collected is bounded by the limit and one text.
    """
    units = children.withColumn("_t", strip(text)).where("_t <> ''")
    # a unit takes three characters at least, so later ones can't be kept; this limits a hot parent before the shuffle
    units = units.withColumn("_n", F.row_number().over(Window.partitionBy(parent).orderBy(order))).where(F.col("_n") <= limit).drop("_n")
    before = Window.partitionBy(parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("_t") + 2).over(before), F.lit(0))
    kept = units.withColumn("_used", used).where((F.col("_used") == 0) | ((F.col("_used") + F.length("_t") <= limit) & (F.col("_used") < limit)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_t").alias("t")))), lambda x: x["t"])
    return kept.groupBy(parent).agg(F.array_join(parts, "\n\n").alias("rolled"))


def enrich(chunks: DataFrame, limit: int = ROLLUP) -> DataFrame:
    """chunks with sections and documents filled in, and enriched. Ids stay as they were."""
    under = rollup(chunks.where("chunk_type = 'paragraph'"), "parent_chunk_id", "chunk_index", "text", limit)
    names = rollup(chunks.where("chunk_type = 'section' and section is not null"), "parent_chunk_id", "chunk_index", "section", limit)
    filled = under.withColumn("_kind", F.lit("section")).unionByName(names.withColumn("_kind", F.lit("document")))
    filled = filled.withColumnsRenamed({"parent_chunk_id": "_id", "rolled": "_rolled"})
    out = chunks.join(filled, (F.col("chunk_id") == F.col("_id")) & (F.col("chunk_type") == F.col("_kind")), "left")
    text = F.when(F.col("_rolled").isNotNull(), F.concat("text", F.lit("\n\n"), "_rolled")).otherwise(F.col("text"))
    done = (F.col("chunk_type") != "section") | F.col("_rolled").isNotNull()
    return out.select(*(text.alias(c) if c == "text" else F.col(c) for c in chunks.columns), done.alias("enriched"))


def indexable(enriched: DataFrame, kinds: list[str] | None = None, done: DataFrame | None = None, least: int = MIN_INDEXED, most: int | None = None) -> DataFrame:
    """Chunks to index: of the kinds, no empty section, long enough, not in done (chunk_id); where a run is to be short the most first by id, so that runs one after the other take all."""
    out = enriched if kinds is None else enriched.where(F.col("chunk_type").isin(kinds))
    out = out.where(F.coalesce("enriched", F.lit(True)) & (F.length(strip("text")) >= least))
    out = out if done is None else new_rows(out, done, "chunk_id")
    return out if most is None else out.orderBy("chunk_id").limit(most)


def index_document(chunks: DataFrame, embedding: Column | None = None) -> DataFrame:
    """The stored form: neither chunk_index nor rows."""
    out = chunks.drop("chunk_index", "rows")
    return out if embedding is None else out.withColumn("embedding", embedding)


def upserted(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key: of the greatest version, the last write. Partial aggregates, so no group is gathered."""
    both = stored.unionByName(new)
    rest = [c for c in both.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r"))
    return last.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def build_counts(chunks: DataFrame) -> DataFrame:
    """Counts by kind, by company and in all, in one pass: (chunk_type, company, n), null where summed over."""
    return chunks.groupingSets([["chunk_type"], ["company"], []], "chunk_type", "company").agg(F.count("*").alias("n"))
