"""Filing structure: headings, sections, paragraphs and documents from ordered leaves of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.ids import chunk_id, token_count
from lodestar.functions.text import normalise_space

#: The heading pattern and the least length of a paragraph.
ITEM = r"(?i)^ITEM\s+(\d+(?:\.\d+|[A-Z])?)\.?\s*[-—]?\s*(.*)$"
MIN_PARAGRAPH = 80


def item_heading(leaves: DataFrame, pattern: str = ITEM, text: str = "text") -> DataFrame:
    """leaves with label (upper case) and title of heading leaves; null on others."""
    is_heading = F.col(text).rlike(pattern)
    return leaves.withColumns(
        {
            "label": F.when(is_heading, F.upper(F.regexp_extract(text, pattern, 1))),
            "title": F.when(is_heading, F.regexp_extract(text, pattern, 2)),
        }
    )


def section_bounds(headed: DataFrame, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """(doc, label, idx, title): of each label the last heading, so a table of contents is skipped."""
    last = headed.where("label is not null").groupBy(doc, "label").agg(F.max_by(F.struct(idx, "title"), idx).alias("last"))
    return last.select(doc, "label", F.col(f"last.{idx}").alias(idx), F.col("last.title").alias("title"))


def section_name(label: str = "label", title: str = "title"):
    return F.concat(F.lit("Item "), F.col(label), F.lit("."), F.when(F.length(title) > 0, F.concat(F.lit(" "), F.col(title))).otherwise(F.lit("")))


def sections(bounds: DataFrame, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """bounds with chunk_index, in the order of idx, and section."""
    order = Window.partitionBy(doc).orderBy(idx)
    return bounds.select("*", (F.row_number().over(order) - 1).alias("chunk_index"), section_name().alias("section"))


def paragraphs(headed: DataFrame, bounds: DataFrame, doc: str = "doc", idx: str = "idx", text: str = "text", least: int = MIN_PARAGRAPH) -> DataFrame:
    """(doc, label, idx, text, chunk_index) of the leaves that are paragraphs.

    A leaf belongs to the last boundary before it (a forward fill in the order of idx); leaves
    before the first boundary, boundaries and short leaves go. In a document without boundaries
    every long leaf is a paragraph with a null label. chunk_index counts within doc and label.
    """
    marked = headed.drop("label", "title").join(bounds.select(doc, idx, F.col("label").alias("bound")), [doc, idx], "left")
    so_far = Window.partitionBy(doc).orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(doc)
    filled = marked.select("*", F.last("bound", ignorenulls=True).over(so_far).alias("label"), F.max("bound").over(whole).alias("any_bound"))
    kept = filled.where(F.col("bound").isNull() & (F.length(text) >= least) & (F.col("label").isNotNull() | F.col("any_bound").isNull()))
    order = Window.partitionBy(doc, "label").orderBy(idx)
    return kept.select(doc, "label", idx, text, (F.row_number().over(order) - 1).alias("chunk_index"))


FILING = ["company", "filing_type", "filing_date", "accession_number", "source_url"]


def finished(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id and token_count."""
    return chunks.withColumns({"chunk_id": chunk_id(), "token_count": token_count("text")})


def document_chunks(filings: DataFrame) -> DataFrame:
    """One level-0 chunk a filing."""
    text = F.concat(F.col("filing_type"), F.lit(" filed by "), F.col("company"), F.lit(" on "), F.col("filing_date").cast("string"))
    return finished(
        filings.select(*FILING, F.lit("document").alias("chunk_type"), F.lit(0).alias("hierarchy_level"), F.lit(None).cast("string").alias("parent_chunk_id"),
                       F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("section"), text.alias("text"))
    )


def filing_chunks(filings: DataFrame, leaves: DataFrame) -> DataFrame:
    """All chunks of filings: documents, sections, paragraphs. leaves: (accession_number, idx, text)."""
    documents = document_chunks(filings)
    parent = documents.select(*FILING, F.col("chunk_id").alias("document_id"))
    headed = item_heading(leaves.withColumn("text", normalise_space("text")).where("text <> ''"))
    bounds = sections(section_bounds(headed, "accession_number"), "accession_number")
    level1 = bounds.join(parent, "accession_number").select(
        *FILING, F.lit("section").alias("chunk_type"), F.lit(1).alias("hierarchy_level"), F.col("document_id").alias("parent_chunk_id"),
        "chunk_index", "section", F.col("section").alias("text"), "label",
    )
    level1 = level1.withColumns({"chunk_id": chunk_id(), "token_count": token_count("text")})
    names = level1.select("accession_number", "label", "section", F.col("chunk_id").alias("section_id"))
    level2 = paragraphs(headed, bounds, "accession_number").join(names, ["accession_number", "label"], "left").join(parent, "accession_number")
    level2 = finished(
        level2.select(*FILING, F.lit("paragraph").alias("chunk_type"), F.lit(2).alias("hierarchy_level"),
                      F.coalesce("section_id", "document_id").alias("parent_chunk_id"), "chunk_index", "section", "text")
    )
    return documents.unionByName(level1.drop("label")).unionByName(level2)
