import hashlib

import pytest
from pyspark.sql import functions as F

from lodestar.operators import enrich, facts, html, structure, tables

LONG = "word " * 20


def filing(spark, leaves):
    f = spark.createDataFrame([("C", "10-K", "2024-01-01", "a-1", "u")], "company string, filing_type string, filing_date string, accession_number string, source_url string")
    rows = [("a-1", i, t) for i, t in enumerate(leaves)]
    return structure.filing_chunks(f, spark.createDataFrame(rows, "accession_number string, idx int, text string"))


def test_last_heading_wins_and_text_before_it_goes(spark):
    out = filing(spark, ["Item 1. Business", LONG + "toc", "Item 1. Business", LONG + "a", LONG + "b", "Item 1A. Risk Factors", LONG + "c", "short"]).collect()
    by = {k: [r for r in out if r["chunk_type"] == k] for k in ("document", "section", "paragraph")}
    assert [r["section"] for r in sorted(by["section"], key=lambda r: r["chunk_index"])] == ["Item 1. Business", "Item 1A. Risk Factors"]
    assert sorted((r["section"], r["chunk_index"], r["text"][-1]) for r in by["paragraph"]) == [("Item 1. Business", 0, "a"), ("Item 1. Business", 1, "b"), ("Item 1A. Risk Factors", 0, "c")]
    assert {r["parent_chunk_id"] for r in by["section"]} == {by["document"][0]["chunk_id"]}


def test_no_headings_gives_flat_paragraphs(spark):
    out = filing(spark, [LONG + "a", "x", LONG + "b"]).where("chunk_type = 'paragraph'").collect()
    assert sorted((r["chunk_index"], r["section"]) for r in out) == [(0, None), (1, None)]


def test_chunk_id_has_none_for_a_null_parent(spark):
    row = filing(spark, []).first()
    text = "10-K filed by C on 2024-01-01"
    assert row["chunk_id"] == hashlib.sha256(f"C:a-1:None:document:0:{text}".encode()).hexdigest()[:16]


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<div>a<p>b</p></div><div>c</div>", ["b", "c"]),
        ("<div><ul><li>x</li></ul></div>", ["x", "x"]),
        ("<p>a<table><tr><td><p>no</td></tr></table></p><p>b", ["a", "b"]),
        ("<p>wo<span>rd</span>s&nbsp; x</p>", ["words x"]),
        ("", []),
    ],
)
def test_leaves(page, texts):
    assert [t for _, _, t in html.leaves(page)] == texts


def test_table_grid_spans_and_headers():
    page = "<table><tr><th>h<th>i</tr><tr><td rowspan=2>a<td colspan=2>b</tr><tr><td>c<td>d</tr></table>"
    assert html.tables(page) == [[["a", "b", "b"], ["a", "c", "d"]]]


def test_bad_page_is_reported(spark):
    pages = spark.createDataFrame([(1, "<p>x")], "id int, html string")
    out = html.parsed(pages, lambda page, row: 1 / 0, "text string", "html").first()
    assert out["text"] is None and "ZeroDivisionError" in out["error"]


def check(spark, rows):
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>").select(tables.cleaned(F.col("rows")).alias("r"))
    return df.select(tables.is_data(F.col("r")).alias("ok"), tables.serialised(F.col("r")).alias("text")).first()


def test_tables(spark):
    data = [["State", "Rate", "%"], ["Oregon", "Oregon", "15.78", "%"], [None, "nan", " ", "Iowa", "3", "%"]]
    assert check(spark, data)["ok"] and check(spark, data)["text"].split("\n")[1] == "Oregon | 15.78 | %"
    toc = [["Item 1.", "Business", "3"], ["Item 1A.", "Risk", "9"], ["Item 2.", "Properties", "12"]]
    assert not check(spark, toc)["ok"]
    assert check(spark, [["Item 1.", "5", "6"], ["a", "1", "2"], ["b", "1", "2"], ["c", "1", "2"], ["d", "1", "2"]])["ok"]
    assert not check(spark, [["a", "1"]])["ok"] and not check(spark, [])["ok"]


def test_rollup_keeps_a_prefix_of_whole_units(spark):
    rows = [("p", i, "x" * 500) for i in range(20)] + [("q", 0, "y" * 3000), ("q", 1, "z"), ("r", 0, "  ")]
    out = {r["p"]: r["rolled"] for r in enrich.rollup(spark.createDataFrame(rows, "p string, i int, text string"), "p", "i").collect()}
    assert len(out["p"]) == 3 * 500 + 2 * 2 and out["q"] == "y" * 3000 and "r" not in out


def test_enrich_keeps_ids(spark):
    chunks = filing(spark, ["Item 1. Business", LONG + "a", "Item 2. Empty"])
    out = enrich.enrich(chunks).collect()
    assert {r["chunk_id"] for r in out} == {r["chunk_id"] for r in chunks.collect()}
    by = {r["section"]: r for r in out if r["chunk_type"] == "section"}
    assert by["Item 1. Business"]["enriched"] and by["Item 1. Business"]["text"].endswith("a") and not by["Item 2. Empty"]["enriched"]
    kept = enrich.indexable(enrich.enrich(chunks)).collect()
    assert "Item 2. Empty" not in [r["section"] for r in kept]


FACT = "company string, concept string, value double, unit string, fiscal_period string, period_type string, accession_number string, source_url string, period_start string, period_end string, fact_id string"


@pytest.mark.parametrize(
    "kind, start, end, year, fits",
    [
        ("duration", "2023-01-01", "2023-12-17", 2023, True),
        ("duration", "2023-01-01", "2023-12-16", 2023, False),
        ("duration", "2022-12-16", "2023-12-31", 2023, True),
        ("duration", "2022-12-15", "2023-12-31", 2023, False),
        ("instant", None, "2023-12-31", 2023, True),
        ("instant", None, "2023-09-30", 2023, False),
        ("instant", None, "2023-12-31", 2022, False),
        ("duration", None, "bad", 2023, False),
    ],
)
def test_answers_year(spark, kind, start, end, year, fits):
    df = spark.createDataFrame([(kind, start, end)], "period_type string, period_start string, period_end string")
    assert df.select(facts.answers_year(F.lit(year)).alias("x")).first()["x"] == fits


def test_lookup_takes_the_least_accession_and_tells_of_misses(spark):
    rows = [("C", "Assets", v, "USD", "FY", "instant", a, "u", None, "2023-12-31", a) for v, a in ((2.0, "0002"), (1.0, "0001"))]
    asked = spark.createDataFrame([("q", "Assets", "C", 2023), ("r", "Assets", "X", 2023)], "query_id string, concept string, company string, fiscal_year int")
    out = {r["query_id"]: r for r in facts.lookup(asked, spark.createDataFrame(rows, FACT)).collect()}
    assert out["q"]["value"] == 1.0 and out["q"]["n_facts"] == 2 and out["r"]["value"] is None and out["r"]["n_facts"] == 0


def test_xbrl(spark):
    payload = '{"facts":{"us-gaap":{"Assets":{"units":{"USD":[{"end":"2023-12-31","val":5,"accn":"1-2","fy":2023,"fp":"FY"}]}},"Other":{"units":{}}},"dei":{}}}'
    row = facts.extract_facts(spark.createDataFrame([("C", "0000000012", payload), ("D", "1", "{}")], "company string, cik string, payload string")).collect()
    assert len(row) == 1 and row[0]["fiscal_period"] == "FY2023FY" and row[0]["source_url"].endswith("/data/12/12/1-2-index.htm")
