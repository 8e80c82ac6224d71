import pytest
from pyspark.sql import functions as F

from lodestar.operators import ingest as I

PAGE = """<html><body><div>Item 1. Business</div><p>toc</p><div>Item 1. Business</div><p>{0}</p><div>Item 2. Properties</div><p>{0}</p>
<table><tr><td>State</td><td>Rate</td></tr><tr><td>Oregon</td><td>15.78</td></tr><tr><td>Iowa</td><td colspan=2>3%</td></tr></table>
<img src="a/Chart1.png" alt=" growth "><img src="logo.png"><img src="graph2.jpg"></body></html>""".format("long text " * 12)


@pytest.fixture()
def filings(spark):
    names = "company string, filing_type string, filing_date string, accession_number string, source_url string, html string"
    return spark.createDataFrame([("C", "10-K", "2024-01-01", "a-1", "https://x.org/d/f.htm", PAGE), ("C", "8-K", "2024-02-01", "a-2", "https://x.org/g.htm", "")], names)


def test_ingest(filings):
    out = I.ingest(filings)
    assert {(r["chunk_type"], r["n"]) for r in out.counts().collect()} == {("document", 2), ("section", 2), ("paragraph", 2), ("table", 1)}
    assert out.errors.count() == 0
    assert out.tables.first()["text"] == "State | Rate\nOregon | 15.78\nIowa | 3%"


def test_charts(spark, filings):
    known = spark.createDataFrame([("https://x.org/d/a/Chart1.png",)], "source_url string")
    describe = lambda refs: refs.withColumn("description", F.concat(F.lit("shows "), "image_url"))
    both = I.chart_chunks(filings, describe).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["source_url"]) for r in both] == [(0, "https://x.org/d/a/Chart1.png"), (1, "https://x.org/d/graph2.jpg")]
    assert [r["chunk_index"] for r in I.chart_chunks(filings, describe, known).collect()] == [1]


def test_retries():
    calls, waits = [], []

    def fail():
        calls.append(1)
        raise RuntimeError("429" if len(calls) < 3 else "broken")

    with pytest.raises(RuntimeError, match="broken"):
        I.retried(fail, sleep=waits.append)()
    assert len(calls) == 3 and waits == [15.0, 30.0]


def test_drafts(spark, filings):
    chunks = I.ingest(filings).chunks
    ids = [r["chunk_id"] for r in chunks.where("chunk_type = 'paragraph'").collect()]
    q = spark.createDataFrame([("e1", "what?", "fact", ids)], "eval_id string, question string, question_type string, chunk_ids array<string>")
    row = I.draft_entries(q, chunks).first()
    assert row["relevant_chunk_ids"] == ids and row["chunk_type"] == "paragraph" and row["verified"] is False
