"""Chunks, tables, facts, enrichment and index upkeep: lines of documents are leaves, turns of conversations children."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.ids import chunk_id, fact_id, token_count
from lodestar.functions.text import normalise_space
from lodestar.operators import enrich, facts, html, structure, tables
from lodestar.operators.resume import new_rows
from lodestar.plans.registry import query, table

#: A line that starts with this word stands for a heading.
HEADING = r"(?i)^(the|la|le|der)\s+(\S+)\s*(.*)$"
HEADING_SQL = r"(?i)^(the|la|le|der)\s+(\S+)\s*(.*)$"


def chunks(spark, d):
    """documents as level-0 chunks."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("source").alias("company"), F.col("lang").alias("filing_type"), F.lit("2024-01-01").alias("filing_date"),
        F.format_string("acc-%d", F.col("doc_id")).alias("accession_number"), F.lit("document").alias("chunk_type"), F.lit(0).alias("hierarchy_level"),
        F.lit(None).cast("string").alias("parent_chunk_id"), F.lit(0).alias("chunk_index"), "text", "doc_id",
    )


@query(
    """SELECT doc_id, substr(sha256(source || ':acc-' || doc_id || ':None:document:0:' || substr(text, 1, 100)), 1, 16) AS chunk_id,
  greatest(1, length(text) // 4)::INT AS token_count FROM documents"""
)
def chunk_ids(spark, d):
    return chunks(spark, d).select("doc_id", chunk_id().alias("chunk_id"), token_count().alias("token_count"))


@query(
    """SELECT doc_id, 'Document ' || lang || ' filed by ' || source || ' on 2024-01-01' AS text FROM documents"""
)
def document_chunks(spark, d):
    filings = chunks(spark, d).withColumns({"filing_type": F.concat(F.lit("Document "), "filing_type"), "source_url": F.lit("")})
    out = structure.document_chunks(filings)
    return out.select(F.substring("accession_number", 5, 20).cast("bigint").alias("doc_id"), "text")


def leaves(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))


LEAVES_SQL = r"leaves AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)"
#: White space of Unicode, as the engine's normalise_space has it.
SPACES = r"[\s\x{00a0}\x{0085}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{000b}]+"


@query(
    rf"""WITH {LEAVES_SQL}, norm AS (SELECT doc, idx, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS text FROM leaves)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS chunk_index, text FROM norm WHERE length(text) >= 80"""
)
def paragraph_chunks(spark, d):
    flat = leaves(spark, d).withColumns({"text": normalise_space("text"), "label": F.lit(None).cast("string"), "title": F.lit(None).cast("string")})
    none = structure.section_bounds(flat)
    return structure.paragraphs(flat, none).select("doc", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


HEADED_SQL = rf"""{LEAVES_SQL}, headed AS (SELECT *, CASE WHEN regexp_matches(text, '{HEADING_SQL}') THEN upper(regexp_extract(text, '{HEADING_SQL}', 1)) END AS label,
  CASE WHEN regexp_matches(text, '{HEADING_SQL}') THEN regexp_extract(text, '{HEADING_SQL}', 2) END AS title FROM leaves),
bounds AS (SELECT doc, label, max(idx) AS idx, arg_max(title, idx) AS title FROM headed WHERE label IS NOT NULL GROUP BY doc, label)"""


@query(
    f"""WITH {HEADED_SQL} SELECT doc, label, idx, row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS chunk_index,
  'Item ' || label || '.' || CASE WHEN length(title) > 0 THEN ' ' || title ELSE '' END AS section FROM bounds"""
)
def section_bounds(spark, d):
    headed = structure.item_heading(leaves(spark, d), HEADING)
    out = structure.sections(structure.section_bounds(headed))
    return out.select("doc", "label", "idx", F.col("chunk_index").cast("long").alias("chunk_index"), "section")


@query(
    f"""WITH {HEADED_SQL}, filled AS (SELECT h.doc, h.idx, h.text, b.label AS bound,
    last_value(b.label IGNORE NULLS) OVER (PARTITION BY h.doc ORDER BY h.idx ROWS UNBOUNDED PRECEDING) AS label, max(b.label) OVER (PARTITION BY h.doc) AS any_bound
  FROM headed h LEFT JOIN bounds b ON h.doc = b.doc AND h.idx = b.idx)
SELECT doc, label, idx, row_number() OVER (PARTITION BY doc, label ORDER BY idx) - 1 AS chunk_index FROM filled
WHERE bound IS NULL AND length(text) >= 80 AND (label IS NOT NULL OR any_bound IS NULL)"""
)
def section_fill(spark, d):
    headed = structure.item_heading(leaves(spark, d), HEADING)
    out = structure.paragraphs(headed, structure.section_bounds(headed))
    return out.select("doc", "label", "idx", F.col("chunk_index").cast("long").alias("chunk_index"))


TRIMMED = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
ROLLUP_SQL = rf"""units AS (SELECT conv_id, turn, {TRIMMED} AS t FROM conversations WHERE length({TRIMMED}) > 0),
sums AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM units)"""


@query(f"WITH {ROLLUP_SQL} SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS rolled FROM sums WHERE used = 0 OR (used + length(t) <= 2000 AND used < 2000) GROUP BY conv_id")
def section_rollup(spark, d):
    return enrich.rollup(table(spark, d, "conversations"), "conv_id", "turn")


@query(
    """WITH units AS (SELECT source, lang, min(doc_id) AS o FROM documents GROUP BY source, lang),
sums AS (SELECT *, coalesce(sum(length(lang) + 2) OVER (PARTITION BY source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM units)
SELECT source, string_agg(lang, chr(10) || chr(10) ORDER BY o) AS rolled FROM sums WHERE used = 0 OR (used + length(lang) <= 8 AND used < 8) GROUP BY source"""
)
def document_rollup(spark, d):
    """Names of sections under a document, here languages under a source, with a budget that bites."""
    names = table(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("o"))
    return enrich.rollup(names, "source", "o", "lang", 8)


@query("SELECT doc_id AS chunk_id FROM documents WHERE lang IN ('en', 'de') AND length(text) >= 20 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def index_filter(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("chunk_type"), "text", F.lit(True).alias("enriched"))
    done = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))
    return enrich.indexable(docs, ["en", "de"], done).select("chunk_id")


@query("SELECT doc_id AS chunk_id, CASE WHEN toxic IS NULL THEN n_chars ELSE -toxic END AS value, CASE WHEN toxic IS NULL THEN 0 ELSE 1 END AS version FROM documents LEFT JOIN labels USING (doc_id)")
def keyed_upsert(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("value"), F.lit(0).alias("version"))
    new = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), (-F.col("toxic")).cast("long").alias("value"), F.lit(1).alias("version"))
    return enrich.upserted(old, new, "chunk_id", "version")


@query("SELECT lang AS chunk_type, NULL AS company, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT NULL, source, count(*) FROM documents GROUP BY source UNION ALL SELECT NULL, NULL, count(*) FROM documents")
def build_counts(spark, d):
    return enrich.build_counts(table(spark, d, "documents").select(F.col("lang").alias("chunk_type"), F.col("source").alias("company")))


CELLS = "['Key', '' || c_custkey, '' || c_custkey, 'nan', ''], [c_mktsegment, c_mktsegment, CASE WHEN c_nationkey < 5 THEN 'Item ' || c_nationkey || '.' ELSE 'Name' END], [c_name, '' || c_nationkey, '12.5%']"


@query(
    f"""WITH raw AS (SELECT c_custkey AS id, [{CELLS}] AS rows FROM customer),
clean AS (SELECT id, list_transform(rows, lambda r: list_filter(list_filter(r, lambda c: c <> '' AND c <> 'nan'), lambda c, i: i = 1 OR c <> list_filter(r, lambda c: c <> '' AND c <> 'nan')[i - 1])) AS r FROM raw),
counts AS (SELECT id, r, len(flatten(r)) AS cells, len(list_filter(flatten(r), lambda c: regexp_matches(c, '^\\(?\\$?[\\d,]+\\.?\\d*%?\\)?$'))) AS numeric,
  len(list_filter(r, lambda x: len(list_filter(x, lambda c: regexp_matches(c, '(?i)^ITEM\\s+\\d+(?:\\.\\d+|[A-Z])?\\.?(?:\\s|$)'))) > 0)) AS heads FROM clean)
SELECT id, array_to_string(list_transform(r, lambda x: array_to_string(x, ' | ')), chr(10)) AS text, len(r) >= 3 AND cells >= 6 AND numeric / cells >= 0.15::DOUBLE AND heads / len(r) <= 0.25::DOUBLE AS is_data FROM counts"""
)
def table_filter(spark, d):
    c = table(spark, d, "customer")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    item = F.when(F.col("c_nationkey") < 5, F.concat(F.lit("Item "), nation, F.lit("."))).otherwise("Name")
    rows = F.array(F.array(F.lit("Key"), key, key, F.lit("nan"), F.lit("")), F.array("c_mktsegment", "c_mktsegment", item), F.array(F.col("c_name"), nation, F.lit("12.5%")))
    clean = c.select(F.col("c_custkey").alias("id"), tables.cleaned(rows).alias("r"))
    return clean.select("id", tables.serialised(F.col("r")).alias("text"), tables.is_data(F.col("r")).alias("is_data"))


def order_facts(spark, d):
    """Facts of orders by status: priorities as companies, each order a filing."""
    o = table(spark, d, "orders")
    entry = F.struct(
        F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_sub(F.to_date("o_orderdate"), 364), "yyyy-MM-dd")).alias("start"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"), F.format_string("%010d", "o_orderkey").alias("accn"),
        F.year("o_orderdate").alias("fy"), F.when(F.col("o_orderstatus") != "P", "FY").alias("fp"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("CY"), F.year("o_orderdate").cast("string"))).alias("frame"),
    )
    concept = F.when(F.col("o_orderstatus") == "F", "NetIncomeLoss").when(F.col("o_orderstatus") == "O", "Assets").otherwise("Ignored")
    payload = F.to_json(F.create_map(F.lit("facts"), F.create_map(F.lit("us-gaap"), F.create_map(concept, F.struct(F.create_map(F.lit("USD"), F.array(entry)).alias("units"))))))
    return facts.extract_facts(o.select(F.col("o_orderpriority").alias("company"), F.col("o_custkey").cast("string").alias("cik"), payload.alias("payload")))


FACTS_SQL = """facts AS (SELECT o_orderpriority AS company, CASE o_orderstatus WHEN 'F' THEN 'NetIncomeLoss' ELSE 'Assets' END AS concept, o_totalprice AS value, 'USD' AS unit,
  CASE WHEN o_orderkey % 3 = 0 THEN 'CY' || year(o_orderdate) ELSE 'FY' || year(o_orderdate) || 'FY' END AS fiscal_period, CASE o_orderstatus WHEN 'F' THEN 'duration' ELSE 'instant' END AS period_type,
  lpad('' || o_orderkey, 10, '0') AS accession_number,
  'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad('' || o_orderkey, 10, '0') || '/' || lpad('' || o_orderkey, 10, '0') || '-index.htm' AS source_url,
  CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate::DATE - 364, '%Y-%m-%d') END AS period_start, strftime(o_orderdate, '%Y-%m-%d') AS period_end
  FROM orders WHERE o_orderstatus <> 'P'),
ids AS (SELECT *, substr(sha256(company || ':' || concept || ':' || fiscal_period || ':' || coalesce(period_start, 'None') || ':' || period_end || ':' || accession_number), 1, 16) AS fact_id FROM facts)"""


@query(f"WITH {FACTS_SQL} SELECT * FROM ids")
def fact_extract(spark, d):
    return order_facts(spark, d)


@query(
    f"""WITH {FACTS_SQL}, asked AS (SELECT DISTINCT company || concept || y AS query_id, company, concept, y AS fiscal_year FROM facts, (SELECT unnest(range(1990, 2000)) AS y)),
fit AS (SELECT query_id, i.* FROM asked JOIN ids i USING (company, concept) WHERE year(period_end::DATE) = fiscal_year AND CASE period_type WHEN 'instant' THEN month(period_end::DATE) = 12
  ELSE datediff('day', period_start::DATE, period_end::DATE) BETWEEN 350 AND 380 END),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY accession_number, fact_id) AS r, count(*) OVER (PARTITION BY query_id) AS n_facts FROM fit) WHERE r = 1)
SELECT a.query_id, a.fiscal_year, b.fact_id, b.value, b.accession_number, coalesce(n_facts, 0) AS n_facts, CASE WHEN abs(b.value) >= 1e9 THEN '$' || format('{{:.2f}}', b.value / 1e9) || ' billion'
  WHEN abs(b.value) >= 1e6 THEN '$' || format('{{:.1f}}', b.value / 1e6) || ' million' ELSE '$' || format('{{:,.2f}}', b.value) END AS formatted_value
FROM asked a LEFT JOIN best b USING (query_id)"""
)
def fact_lookup(spark, d):
    f = order_facts(spark, d)
    years = F.explode(F.sequence(F.lit(1990), F.lit(1999)))
    asked = f.select("company", "concept").distinct().select("company", "concept", years.alias("fiscal_year"))
    asked = asked.withColumn("query_id", F.concat("company", "concept", F.col("fiscal_year").cast("string")))
    return facts.lookup(asked, f).select("query_id", "fiscal_year", "fact_id", "value", "accession_number", "n_facts", facts.formatted().alias("formatted_value"))


@query(
    """WITH f AS (SELECT substr(sha256(n_name || ':Assets:None:None:None:' || r_name), 1, 16) AS fact_id FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['USD', 'EUR'])))
SELECT fact_id, count(*) AS n FROM f GROUP BY fact_id HAVING count(*) > 1"""
)
def duplicate_fact_ids(spark, d):
    """One concept in two units shares its id; the check reports it."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    f = n.select(F.col("n_name").alias("company"), F.lit("Assets").alias("concept"), none.alias("fiscal_period"), none.alias("period_start"), none.alias("period_end"),
                 F.col("r_name").alias("accession_number"), F.explode(F.array(F.lit("USD"), F.lit("EUR"))).alias("unit"))
    return facts.duplicate_ids(f.withColumn("fact_id", fact_id()))


@query()
def html_paragraphs(spark, d):
    found = html.html_leaves(table(spark, d, "pages").select("page_id", "html"))
    return found.withColumn("text", normalise_space("text"))


@query()
def html_tables(spark, d):
    """Whole pages, each behind a small table of its facts, as the pages themselves may have none."""
    p = table(spark, d, "pages")
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell("page_id"), cell("url"), F.lit("<td colspan=2>7</td></tr>"))
    page = F.concat(F.lit("<table><thead><tr><th>a<th>b</tr></thead>"), row, row, row, F.lit("</table>"), F.coalesce("html", F.lit("")))
    found = html.html_tables(p.select("page_id", page.alias("html")))
    return found.select("page_id", "table_index", tables.serialised(tables.cleaned(F.col("rows"))).alias("text"), tables.is_data(tables.cleaned(F.col("rows"))).alias("is_data"))


@query(
    """SELECT page_id, 0 AS ref_index, regexp_extract(url, '^(https?://[^/]+)', 1) || '/img/Chart-' || page_id || '.png' AS image_url, 'a graph' AS alt_text, 'image/png' AS mime FROM pages"""
)
def chart_refs(spark, d):
    """Whole pages, each behind a chart and another image, as the pages themselves may have none."""
    p = table(spark, d, "pages")
    images = F.concat(F.lit("<p><img src='/img/Chart-"), F.col("page_id").cast("string"), F.lit(".png' alt=' a graph '><img src='logo.gif'></p>"))
    page = F.concat(images, F.coalesce("html", F.lit("")))
    return html.chart_refs(p.select("page_id", "url", page.alias("html")), "html", "url", "page_id", "url").drop("url", "error")


@query("SELECT doc_id, lang, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_new_rows(spark, d):
    """Labels stand for what an earlier run has stored."""
    docs, stored = table(spark, d, "documents").select("doc_id", "lang", "text"), table(spark, d, "labels").select("doc_id")
    return new_rows(docs, stored, "doc_id")
