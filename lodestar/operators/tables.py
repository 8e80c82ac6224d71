"""Tables as arrays of rows: cleaning, the test for data, serialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.ids import chunk_id, token_count
from lodestar.functions.text import strip
from lodestar.operators.structure import FILING

#: The shapes of numeric and of heading cells, and the thresholds of a data table.
NUMERIC = r"^\(?\$?[\d,]+\.?\d*%?\)?$"
HEADING = r"(?i)^ITEM\s+\d+(?:\.\d+|[A-Z])?\.?(?:\s|$)"
MIN_ROWS, MIN_CELLS, MIN_NUMERIC, MAX_HEADING_ROWS = 3, 6, 0.15, 0.25


def cleaned(rows: Column) -> Column:
    """Stripped cells without empty ones, repeats side by side as one; rows without cells go."""

    def row(r: Column) -> Column:
        cells = F.filter(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: (c != "") & (c != "nan"))
        return F.transform(F.array(cells), lambda x: F.filter(x, lambda c, i: (i == 0) | (c != F.get(x, i - 1))))[0]

    return F.filter(F.transform(rows, row), lambda r: F.size(r) > 0)


def is_data(rows: Column) -> Column:
    """Of cleaned rows: enough rows and cells, enough of them numeric, few rows with a heading."""
    cells = F.flatten(rows)
    numeric = F.size(F.filter(cells, lambda c: c.rlike(NUMERIC)))
    headings = F.size(F.filter(rows, lambda r: F.exists(r, lambda c: c.rlike(HEADING))))
    enough = (F.size(rows) >= MIN_ROWS) & (F.size(cells) >= MIN_CELLS)
    return enough & (numeric / F.size(cells) >= MIN_NUMERIC) & (headings / F.size(rows) <= MAX_HEADING_ROWS)


def serialised(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def table_chunks(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of the data tables among found (accession_number, table_index, rows).

    documents: level-0 chunks, the parents. chunk_index counts the tables that are kept.
    """
    good = found.withColumn("clean", cleaned(F.col("rows"))).where(is_data(F.col("clean")))
    order = Window.partitionBy("accession_number").orderBy("table_index")
    good = good.select("accession_number", (F.row_number().over(order) - 1).alias("chunk_index"), serialised(F.col("clean")).alias("text"), "rows")
    parents = documents.select(*FILING, F.col("chunk_id").alias("parent_chunk_id"))
    out = good.join(parents, "accession_number").select(
        *FILING, F.lit("table").alias("chunk_type"), F.lit(1).alias("hierarchy_level"), "parent_chunk_id", "chunk_index",
        F.lit(None).cast("string").alias("section"), "text", "rows",
    )
    return out.withColumns({"chunk_id": chunk_id(), "token_count": token_count("text")})
