import pytest


@pytest.fixture()
def docs(spark):
    """Rows (doc_id, text) as a table with the columns of documents, and one whose name clashes with inner ones."""

    def make(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("id"), F.lit(2).alias("label"), F.lit(3).alias("key"))

    return make


LONG = "lorem ipsum dolor sit amet. " * 8000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same text here, twice over. " * 3), (5, "same text here, twice over. " * 3), (None, "no id at all in this row"), (6, "x" * 100_000)]


@pytest.fixture()
def odd(docs):
    return docs(ODD)


@pytest.fixture()
def empty(docs):
    return docs([])
