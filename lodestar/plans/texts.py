"""Routing, replies of models, and their evaluation, over literals and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.text import regexp_count
from lodestar.operators import evaluation, facts, generation, route, sampling
from lodestar.plans.registry import query, table
from lodestar.sources.files import padded_cik, submissions

#: Questions by the remainder of an order's key, with its year, and the route each is to take.
QUESTIONS = [
    ("What was Columbia Banking's net income in {year}?", "structured"),
    ("Why was Columbia's net income lower in {year} than before?", "semantic"),
    ("Total deposits of Glacier Bancorp for FY{year}", "structured"),
    ("Net interest income of WesBanco FY {year}?", "structured"),
    ("What was net income in {year}?", "semantic"),
    ("What does Umpqua say about deposits?", "semantic"),
    ("ssb diluted eps {year}", "structured"),
    ("Describe the strategy of South State", "semantic"),
    ("The asterisk next to UMPQ assets {year}", "structured"),
    ("Interest income of COLB, {year} and 2019", "structured"),
    ("Shareholders' equity at southstate in {year}", "structured"),
    ("columbian assets {year}", "semantic"),
    ("", "semantic"),
    ("Assets of Glacier in 2150?", "semantic"),
]


def values_sql(rows: list[tuple], *names: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        return str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({', '.join(names)})"


def phrase_sql(phrases: dict[str, str]) -> str:
    rows = [(i, p, n) for i, (p, n) in enumerate(route.longest_first(phrases))]
    return values_sql(rows, "ord", "phrase", "name")


def classify_sql(source: str) -> str:
    """query_id, question of source -> its route."""
    marks = "[" + ", ".join(f"'{m}'" for m in route.NARRATIVE) + "]"
    return f"""WITH q AS (SELECT *, trim(lower(question)) AS low FROM {source}),
concepts AS (SELECT query_id, arg_min(name, ord) AS concept, arg_min(phrase, ord) AS phrase FROM q JOIN {phrase_sql(route.CONCEPT_PHRASES)} ON regexp_matches(low, '\\b' || phrase || '\\b') GROUP BY query_id),
companies AS (SELECT query_id, arg_min(name, ord) AS company FROM q JOIN {phrase_sql(route.COMPANY_PHRASES)} ON regexp_matches(low, '\\b' || phrase || '\\b') GROUP BY query_id),
found AS (SELECT q.*, concept, phrase, company, try_cast(nullif(regexp_extract(low, '\\b(?:fy\\s*)?(19\\d{{2}}|20\\d{{2}})\\b', 1), '') AS INT) AS fiscal_year,
  list_filter({marks}, lambda m: contains(low, m))[1] AS marker FROM q LEFT JOIN concepts USING (query_id) LEFT JOIN companies USING (query_id)),
routed AS (SELECT query_id, question, CASE WHEN marker IS NULL AND concept IS NOT NULL AND company IS NOT NULL AND fiscal_year IS NOT NULL THEN 'structured' ELSE 'semantic' END AS route,
  concept, company, fiscal_year, CASE WHEN marker IS NOT NULL THEN ['asks for an explanation: ''' || marker || ''''] ELSE [
    CASE WHEN concept IS NOT NULL THEN 'concept ' || concept || ' by ''' || phrase || '''' ELSE 'no concept named' END,
    CASE WHEN company IS NOT NULL THEN 'company ' || company ELSE 'no company named' END,
    CASE WHEN fiscal_year IS NOT NULL THEN 'year ' || fiscal_year ELSE 'no year named' END] END AS reasons FROM found)"""


ORDER_QUESTIONS = f"""(SELECT o_orderkey AS query_id, replace(question, '{{year}}', '' || year(o_orderdate)) AS question, expected FROM orders
  JOIN {values_sql([(i, *q) for i, q in enumerate(QUESTIONS)], "ord", "question", "expected")} ON ord = o_orderkey % {len(QUESTIONS)})"""


def asked(spark, d):
    """A question for each order."""
    kinds = F.array(*(F.struct(F.lit(q).alias("question"), F.lit(e).alias("expected_route")) for q, e in QUESTIONS))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.year("o_orderdate").cast("string").alias("year"), F.get(kinds, (F.col("o_orderkey") % len(QUESTIONS)).cast("int")).alias("k"))
    return o.select("query_id", F.replace("k.question", F.lit("{year}"), F.col("year")).alias("question"), "k.expected_route")


@query(f"{classify_sql(ORDER_QUESTIONS)} SELECT * FROM routed")
def route_classify(spark, d):
    return route.classify(asked(spark, d).drop("expected_route"))


@query(f"{classify_sql('(SELECT item_id AS query_id, text AS question FROM benchmark)')} SELECT query_id, route, concept, company, fiscal_year FROM routed")
def route_benchmark(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return route.classify(items).drop("question", "reasons")


@query(f"{classify_sql(ORDER_QUESTIONS)} SELECT expected, route AS predicted, count(*) AS n FROM routed JOIN q USING (query_id) GROUP BY ALL")
def routing_confusion(spark, d):
    return evaluation.confusion(route.classify(asked(spark, d)))


@query(
    f"""{classify_sql(ORDER_QUESTIONS)}, e AS (SELECT expected, route FROM routed JOIN q USING (query_id))
SELECT count(*) AS n, round(count(*) FILTER (expected = route) / count(*), 6) AS accuracy,
  round(count(*) FILTER (expected = 'structured' AND route = 'structured') / nullif(count(*) FILTER (route = 'structured'), 0), 6) AS structured_precision,
  round(count(*) FILTER (expected = 'structured' AND route = 'structured') / nullif(count(*) FILTER (expected = 'structured'), 0), 6) AS structured_recall FROM e"""
)
def routing_summary(spark, d):
    return evaluation.routing_summary(route.classify(asked(spark, d)))


def turns(spark, d):
    """Turns of conversations with an id of their own."""
    return table(spark, d, "conversations").select("*", (8 * F.col("conv_id") + F.col("turn")).alias("id"))


TURNS_SQL = "(SELECT *, 8 * conv_id + turn AS id FROM conversations)"


@query(
    f"""WITH a AS (SELECT id, text || ' [' || turn || '] [' || conv_id % 9 || '][' || turn || '] [12345678901234567890]' || CASE WHEN id % 5 = 0 THEN ' THE PROVIDED FILINGS DO NOT STATE THIS, I think' ELSE '' END AS answer, conv_id % 7 AS n FROM {TURNS_SQL})
SELECT id, list_transform(list_filter(list_distinct_ordered, lambda x: x BETWEEN 1 AND n), lambda x: x::INT) AS cited, contains(lower(answer), 'the provided filings do not state this') AS refused FROM (
  SELECT *, list_filter(nums, lambda x, i: NOT list_contains(nums[1:i - 1], x)) AS list_distinct_ordered FROM (
    SELECT *, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: coalesce(try_cast(x AS INT), 0)) AS nums FROM a))"""
)
def citations(spark, d):
    """Turns as answers that cite a passage by their turn, and one by their conversation."""
    mark = lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))
    refusal = F.when(F.col("id") % 5 == 0, " THE PROVIDED FILINGS DO NOT STATE THIS, I think").otherwise("")
    answer = F.concat("text", F.lit(" "), mark(F.col("turn")), F.lit(" "), mark(F.col("conv_id") % 9), mark(F.col("turn")), F.lit(" [12345678901234567890]"), refusal)
    a = turns(spark, d).select("id", answer.alias("answer"), (F.col("conv_id") % 7).cast("int").alias("n"))
    return a.select("id", generation.cited("answer", "n").alias("cited"), generation.is_refusal("answer").alias("refused"))


#: What a model puts before its questions, by the remainder of the turn's id.
LISTED = ["1. ", "2) ", "- ", "* \"", "• ", "Sure, ", ""]


@query(
    f"""WITH replies AS (SELECT conv_id AS id, string_agg(mark || replace(substr(text, 1, 40), chr(10), ' ') || '?' || CASE WHEN id % 7 = 3 THEN '"' ELSE '' END, chr(10) ORDER BY turn)
    || chr(10) || 'Here are the questions, are they not?' || chr(10) || 'short?' || chr(10) || 'Not a question at all.' AS reply
  FROM {TURNS_SQL} JOIN {values_sql(list(enumerate(LISTED)), 'ord', 'mark')} ON ord = id % 7 GROUP BY conv_id),
lines AS (SELECT id, i, trim(trim(regexp_replace(l, '^\\s*(?:[-*•]|\\d+[.)])\\s*', '')), '"') AS q FROM (
  SELECT id, unnest(string_split(reply, chr(10))) AS l, generate_subscripts(string_split(reply, chr(10)), 1) AS i FROM replies)),
good AS (SELECT id, q, min(i) AS i FROM lines WHERE q LIKE '%?' AND length(q) >= 15 AND NOT (lower(q) LIKE 'here are%' OR lower(q) LIKE 'sure%' OR lower(q) LIKE 'questions:%') GROUP BY id, q)
SELECT v.id, coalesce(list(q ORDER BY i) FILTER (q IS NOT NULL), []::VARCHAR[])[1:3] AS questions FROM replies v LEFT JOIN good USING (id) GROUP BY v.id"""
)
def parse_questions(spark, d):
    """A conversation's turns as the lines of a reply that lists questions."""
    mark = F.get(F.array(*map(F.lit, LISTED)), (F.col("id") % 7).cast("int"))
    line = F.concat(mark, F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" ")), F.lit("?"), F.when(F.col("id") % 7 == 3, '"').otherwise(""))
    by = turns(spark, d).groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    rest = ["Here are the questions, are they not?", "short?", "Not a question at all."]
    replies = by.select("id", F.array_join(F.concat(F.transform("x", lambda x: x["line"]), F.array(*map(F.lit, rest))), "\n").alias("reply"))
    return replies.select("id", generation.questions_in("reply").alias("questions"))


#: Replies by the remainder of the turn's id: a thought that ends, one that began before, one that never ends, two, none.
THOUGHTS = ["<think>a\n{text}\nb</think> The answer.", "half a thought {text}</think>\n{text}", "<think>never ends {text}", "<THINK>{text}</THINK>y<think>z</think> {text} ", "{text}"]


@query(
    f"""WITH t AS (SELECT id, replace(form, '{{text}}', text) AS text FROM {TURNS_SQL} JOIN {values_sql(list(enumerate(THOUGHTS)), 'ord', 'form')} ON ord = id % {len(THOUGHTS)})
SELECT id, trim(CASE WHEN contains(c, '</think>') THEN regexp_replace(c, '(?is)^.*?</think>', '') ELSE c END, ' ' || chr(10)) AS answer
FROM (SELECT id, regexp_replace(text, '(?is)<think>.*?</think>', '', 'g') AS c FROM t)"""
)
def strip_reasoning(spark, d):
    form = F.get(F.array(*map(F.lit, THOUGHTS)), (F.col("id") % len(THOUGHTS)).cast("int"))
    t = turns(spark, d).select("id", F.replace(form, F.lit("{text}"), F.col("text")).alias("text"))
    return t.select("id", generation.without_reasoning("text").alias("answer"))


#: Verdicts by the remainder of the document's id, with the claims it makes and how many are supported.
VERDICTS = [
    '{"total_claims": <n>, "supported_claims": <k>, "unsupported": ["x"]}', '```json\n{"total_claims": <n>, "supported_claims": <k>, "unsupported": []}\n```',
    "no json, but <n> claims", '{"total_claims": 0, "supported_claims": 0}', '```\n{"total_claims": <n>}\n```',
]


@query(
    f"""WITH v AS (SELECT doc_id AS id, replace(replace(form, '<n>', '' || (n_chars % 9 + 1)), '<k>', '' || (n_chars % 9 + 1) * (n_chars % 4) // 3) AS reply FROM documents JOIN {values_sql(list(enumerate(VERDICTS)), 'ord', 'form')} ON ord = doc_id % {len(VERDICTS)}),
bare AS (SELECT id, CASE WHEN reply LIKE '```%' THEN regexp_replace(string_split(reply, '```')[2], '^json', '') ELSE reply END AS r FROM v),
j AS (SELECT id, CASE WHEN json_valid(r) THEN r::JSON END AS j FROM bare)
SELECT id, CASE WHEN j IS NOT NULL THEN coalesce((j->>'total_claims')::INT, 0) END AS total_claims, CASE WHEN j IS NOT NULL THEN coalesce((j->>'supported_claims')::INT, 0) END AS supported_claims,
  round(coalesce((j->>'supported_claims')::INT, 0) / nullif((j->>'total_claims')::INT, 0), 6) AS support_rate, CASE WHEN j IS NULL THEN 'unparseable' END AS judge_error FROM j"""
)
def judge_parse(spark, d):
    """A verdict for each document, by its length."""
    n = F.col("n_chars") % 9 + 1
    k = F.floor(n * (F.col("n_chars") % 4) / 3)
    form = F.get(F.array(*map(F.lit, VERDICTS)), (F.col("doc_id") % len(VERDICTS)).cast("int"))
    reply = F.replace(F.replace(form, F.lit("<n>"), n.cast("string")), F.lit("<k>"), k.cast("string"))
    v = table(spark, d, "documents").select(F.col("doc_id").alias("id"), generation.verdict(reply).alias("v"))
    return v.select("id", "v.total_claims", "v.supported_claims", F.round("v.support_rate", 6).alias("support_rate"), "v.judge_error")


@query(
    """SELECT conv_id, 'You answer questions' = substr(p, 1, 20) AS starts, length(p) - length(replace(p, ' filed ', '')) AS filed, substr(p, strpos(p, '--- PASSAGES ---'), 1000000) AS body FROM (
  SELECT conv_id, 'You answer questions' || chr(10) || '--- PASSAGES ---' || chr(10) || chr(10) ||
    string_agg('[' || n || '] ' || role || ' turn filed ' || turn || ' — s' || turn || chr(10) || trim(text, ' ' || chr(10)), chr(10) || chr(10) ORDER BY n) ||
    chr(10) || chr(10) || '--- QUESTION ---' || chr(10) || 'q' || conv_id || chr(10) || chr(10) || '--- ANSWER ---' || chr(10) AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id)"""
)
def prompts(spark, d):
    """Turns of a conversation as passages."""
    c = table(spark, d, "conversations")
    p = F.struct("turn", F.col("role").alias("company"), F.lit("turn").alias("filing_type"), F.col("turn").cast("string").alias("filing_date"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("section"), "text")
    by = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(p)).alias("passages"))
    by = by.select("conv_id", F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question"), F.slice("passages", 1, generation.MOST_PASSAGES).alias("passages"))
    out = by.withColumn("p", generation.prompt())
    filed = 7 * regexp_count("body", " filed ")
    return out.select("conv_id", F.startswith("p", F.lit("You answer questions")).alias("starts"), F.substring_index("p", "--- PASSAGES ---", -1).alias("b")).select(
        "conv_id", "starts", F.concat(F.lit("--- PASSAGES ---"), "b").alias("body")
    ).withColumn("filed", filed)


@query(
    """WITH r AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'structured' ELSE 'semantic' END AS route, toxic = 1 AS refused, n_chars % 4 AS n_citations, CASE WHEN doc_id % 5 > 0 THEN least(1.0, (n_chars % 11) / 7.0) END AS support_rate, quality = 1 AS judged FROM labels JOIN documents USING (doc_id)),
s AS (SELECT *, route = 'semantic' AND NOT refused AS answered FROM r), d AS (SELECT count(*) AS total FROM documents)
SELECT 'all' AS split, any_value(total) AS questions_in_eval_set, count(*) AS answers_generated, round(count(*) / any_value(total), 6) AS coverage, count(*) FILTER (route = 'structured') AS structured_route, count(*) FILTER (route = 'semantic') AS semantic_route,
  count(*) FILTER (route = 'semantic' AND refused) AS refusals, round(count(*) FILTER (route = 'semantic' AND refused) / count(*) FILTER (route = 'semantic'), 6) AS refusal_rate,
  count(*) FILTER (answered AND n_citations > 0) AS answers_with_valid_citations, round(count(*) FILTER (answered AND n_citations > 0) / count(*) FILTER (answered), 6) AS citation_coverage,
  count(*) FILTER (answered AND judged) AS judged_answers, round(avg(support_rate::DOUBLE) FILTER (answered AND judged), 6) AS mean_claim_support_rate, count(*) FILTER (answered AND judged AND support_rate = 1) AS fully_supported_answers FROM s, d"""
)
def groundedness_summary(spark, d):
    """Labels stand for answers: toxic ones were refused, those of quality judged."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    rows = table(spark, d, "labels").join(docs, "doc_id").select(
        F.when(F.col("doc_id") % 3 == 0, "structured").otherwise("semantic").alias("route"), (F.col("toxic") == 1).alias("refused"), (F.col("n_chars") % 4).alias("n_citations"),
        F.when(F.col("doc_id") % 5 > 0, F.least(F.lit(1.0), F.col("n_chars") % 11 / 7.0)).alias("support_rate"), (F.col("quality") == 1).alias("judged"),
    )
    return evaluation.groundedness(rows, docs.count())


@query(
    """SELECT count(*) AS n, count(*) FILTER (a) AS chart_type_correct, count(*) FILTER (b) AS trend_direction_correct, count(*) FILTER (c) AS labels_correct, count(*) FILTER (a AND b AND c) AS all_correct
FROM (SELECT quality = 1 AS a, toxic = 0 AS b, doc_id % 2 = 0 AS c FROM labels)"""
)
def chart_eval(spark, d):
    g = table(spark, d, "labels").select((F.col("quality") == 1).alias("chart_type_correct"), (F.col("toxic") == 0).alias("trend_direction_correct"), (F.col("doc_id") % 2 == 0).alias("labels_correct"))
    return evaluation.chart_rubric(g)


@query(
    """WITH e AS (SELECT '' || o_orderkey AS eval_id, CASE o_orderstatus WHEN 'F' THEN 'NetIncomeLoss' ELSE 'Assets' END AS concept, lpad('' || o_orderkey, 10, '0') AS accession_number,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS expected_value, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'xbrl_fact' END AS kind, o_totalprice AS v, o_orderstatus <> 'P' AS there FROM orders)
SELECT eval_id, CASE WHEN there THEN v END AS value, there::INT AS n_found, round(CASE WHEN there THEN abs(v - expected_value) / abs(expected_value) END, 9) AS relative_error,
  coalesce(there AND abs(v - expected_value) / abs(expected_value) <= 1e-6 AND kind = 'xbrl_fact', false) AS passed FROM e"""
)
def extraction_check(spark, d):
    from lodestar.plans.structure import order_facts

    o = table(spark, d, "orders")
    expected = o.select(
        F.col("o_orderkey").cast("string").alias("eval_id"), F.when(F.col("o_orderstatus") == "F", "NetIncomeLoss").otherwise("Assets").alias("concept"),
        F.format_string("%010d", "o_orderkey").alias("accession_number"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1).alias("expected_value"),
        F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise("xbrl_fact").alias("kind"),
    )
    out = evaluation.extraction(expected, order_facts(spark, d))
    return out.withColumn("relative_error", F.round("relative_error", 9))


@query(
    """WITH v AS (SELECT o_orderkey AS id, o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.0071234567 WHEN 1 THEN 1.0012345 WHEN 2 THEN -431.771234 ELSE 77123.4567 END::DOUBLE AS v, CASE o_orderkey % 3 WHEN 0 THEN 'shares' WHEN 1 THEN 'USD/shares' ELSE 'USD' END AS unit FROM orders)
SELECT id, CASE unit WHEN 'USD' THEN CASE WHEN abs(v) >= 1e9 THEN '$' || format('{:.2f}', v / 1e9) || ' billion' WHEN abs(v) >= 1e6 THEN '$' || format('{:.1f}', v / 1e6) || ' million' ELSE '$' || format('{:,.2f}', v) END
  WHEN 'USD/shares' THEN '$' || format('{:.2f}', v) || ' per share' ELSE format('{:,.2f}', v) || ' ' || unit END AS shown FROM v"""
)
def format_value(spark, d):
    """Prices of orders in many sizes as figures of three units."""
    kind = F.col("o_orderkey") % 4
    scale = F.when(kind == 0, 0.0071234567).when(kind == 1, 1.0012345).when(kind == 2, -431.771234).otherwise(77123.4567)
    unit = F.when(F.col("o_orderkey") % 3 == 0, "shares").when(F.col("o_orderkey") % 3 == 1, "USD/shares").otherwise("USD")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * scale).alias("value"), unit.alias("unit"))
    return o.select("id", facts.formatted().alias("shown"))


@query(
    """SELECT 't' || n_nationkey AS company, CASE WHEN n_nationkey < 2 THEN '12345678901' ELSE lpad('' || n_nationkey * 977, 10, '0') END AS cik FROM nation"""
)
def cik_map(spark, d):
    n = table(spark, d, "nation").select(
        F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("company"), (F.col("n_nationkey") * 977).alias("cik"), F.when(F.col("n_nationkey") < 2, "12345678901").alias("own")
    )
    return n.select("company", padded_cik("cik", "own").alias("cik"))


@query(
    """SELECT n_name AS company, f AS filing_type, dt AS filing_date, 'https://www.sec.gov/Archives/edgar/data/' || n_nationkey || '/' || replace(a, '-', '') || '/d.htm' AS document_url FROM nation,
  (VALUES ('10-K', '2023-02-01', '1-23-1'), ('8-K', '2023-03-01', '1-23-2'), ('10-Q', '2024-01-01', '1-24-1'), ('10-Q', '2023-12-31', '1-23-9')) t(f, dt, a) WHERE f IN ('10-K', '10-Q') AND dt BETWEEN '2023-01-01' AND '2023-12-31'"""
)
def filings_from_submissions(spark, d):
    payload = '{"filings":{"recent":{"form":["10-K","8-K","10-Q","10-Q"],"filingDate":["2023-02-01","2023-03-01","2024-01-01","2023-12-31"],"accessionNumber":["1-23-1","1-23-2","1-24-1","1-23-9"],"primaryDocument":["d.htm","d.htm","d.htm","d.htm"]}}}'
    n = table(spark, d, "nation").select(F.col("n_name").alias("company"), F.col("n_nationkey").cast("string").alias("cik"), F.lit(payload).alias("payload"))
    return submissions(n, ["10-K", "10-Q"], "2023-01-01", "2023-12-31").select("company", "filing_type", "filing_date", "document_url")


@query(
    r"""SELECT doc_id, 2 * len(regexp_extract_all(text, '(?i)\$\s?[\d,]+(?:\.\d+)?\s*(?:million|billion|thousand)?')) + 2 * len(regexp_extract_all(text, '\d+(?:\.\d+)?\s?%')) + len(regexp_extract_all(text, '\b(?:19|20)\d{2}\b')) AS score FROM documents"""
)
def specificity(spark, d):
    return table(spark, d, "documents").select("doc_id", sampling.specificity("text").alias("score"))


@query(
    """SELECT lang, count(*) FILTER (quality = 1) AS verified, count(*) AS total, CASE WHEN count(*) FILTER (quality = 1) >= count(*) THEN NULL WHEN count(*) FILTER (quality = 1) = 0 THEN 'Nobody has read these questions over yet: all of them are machine drafts, and the figures may move once some are reviewed.'
  ELSE count(*) FILTER (quality = 1) || ' of ' || count(*) || ' questions were reviewed by a person; the others are machine drafts, so figures that rest on them may move.' END AS note FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
)
def verification_notes(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    by = rows.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("verified"), F.count("*").alias("total"))
    return by.withColumn("note", evaluation.verification_note(F.col("verified"), F.col("total")))

