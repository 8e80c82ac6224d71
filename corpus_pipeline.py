"""The corpus pipeline: stages over documents, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.decontaminate import decontaminate
from lodestar.llm.line_dedup import dedup_lines
from lodestar.llm.near_duplicates import near_duplicates
from lodestar.llm.packing import pack
from lodestar.llm.quality import clean_lines
from lodestar.llm.shared import cut, small, table, text_or_empty


def held(docs: DataFrame) -> DataFrame:
    """(doc_id, text, document): all columns in one, so that none clashes with those of an operator."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("document"))


def with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of the document, with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col("document")[c].alias(c) for c in columns))


def only(rows: DataFrame, flag: str, *columns: str) -> DataFrame:
    """The columns of the rows whose flag is true. Catalyst would push a filter below the projection that makes the flag, and
    so work out its expressions once for the filter and again for the rows; a generator stays where it is.
    """
    row = F.struct(flag, *columns)
    return rows.select(F.explode(F.filter(F.array(row), lambda x: x[flag])).alias("row")).select(*(F.col("row")[c].alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule go, and documents that fail or lose too much.

    Null and empty texts have too few words and go; null ids and repeated rows are judged like any other.
    """
    judged = clean_lines(held(docs), keep_columns=True)
    return with_text(only(judged, "kept", "document", "clean_text"), docs.columns, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which no line is left.

    Texts without a line of words, null ones too, stay as they are. Of a line's group that of the
    least id, then place, stays; null ids come last; rows of equal id and text keep the same lines.
    """
    left = dedup_lines(held(docs)).where("n_lines_removed = 0 or n_lines > n_lines_removed")
    return with_text(left, docs.columns, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document of the smallest id stays.

    Rows are known by their id and text: of rows that have both in common one stays, and a row isn't
    removed for another text of its id. Texts without words are near nothing and stay, as rows of a null id do.
    """
    found = near_duplicates(docs, width=5, num=80, den=100).where("doc_id is not null and n_shingles > 0")
    rows = found.groupBy("doc_id", "text_key").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("times"))
    rows = cut(rows.where("not kept or times > 1"), "rows-gone")
    key = (F.col("doc_id").cast("long") == F.col("id_")) & (F.xxhash64(text_or_empty("text")) == F.col("key_"))

    def named(some: DataFrame) -> DataFrame:
        return small(some.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")))

    whole = held(docs)
    left = whole.join(named(rows), key, "left_anti").select("document")
    again = whole.join(named(rows.where("kept")), key, "left_semi")
    again = again.dropDuplicates(["doc_id", "text"]).select("document")
    return left.unionByName(again).select("document.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, each by its own text; null and empty texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 4096 tokens. A null text counts as empty; repeated rows are packed as often."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SimHash, MinHash, alignment and tokenizers are beyond SQL; the tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
