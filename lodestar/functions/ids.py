"""Content-addressed ids. They must equal those of earlier indexes bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_LENGTH, ID_TEXT = 16, 100


def digest(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the parts joined by colons; a null part reads None."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    joined = texts[0]
    for t in texts[1:]:
        joined = F.concat(joined, F.lit(":"), t)
    return F.substring(F.sha2(joined, 256), 1, ID_LENGTH)


def chunk_id(company="company", accession="accession_number", parent="parent_chunk_id", kind="chunk_type", index="chunk_index", text="text") -> Column:
    """Only the first 100 characters of the text take part, so later enrichment keeps the id."""
    head = F.substring(F.col(text), 1, ID_TEXT)
    return digest(*(F.col(c) for c in (company, accession, parent, kind, index)), head)


def fact_id(company="company", concept="concept", period="fiscal_period", start="period_start", end="period_end", accession="accession_number") -> Column:
    """Neither unit nor value takes part: one concept in two units has one id."""
    return digest(*(F.col(c) for c in (company, concept, period, start, end, accession)))


def token_count(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))
