"""Tagged numeric facts: extraction, lookup by year, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.ids import fact_id
from lodestar.schemas import COMPANY_FACTS

#: The concepts kept, and the days of a whole year.
CONCEPTS = (
    "Assets", "Liabilities", "StockholdersEquity", "Deposits", "NetIncomeLoss", "InterestAndDividendIncomeOperating", "InterestIncomeExpenseNet",
    "LoansAndLeasesReceivableNetReportedAmount", "ProvisionForLoanAndLeaseLosses", "RevenueFromContractWithCustomerExcludingAssessedTax",
    "EarningsPerShareBasic", "EarningsPerShareDiluted",
)
MIN_DAYS, MAX_DAYS = 350, 380


def fiscal_period(frame: Column, fy: Column, fp: Column) -> Column:
    return F.coalesce(frame, F.concat(F.lit("FY"), F.coalesce(fy.cast("string"), F.lit("?")), F.coalesce(fp, F.lit(""))))


def filing_url(cik: Column, accession: Column) -> Column:
    bare = F.replace(accession, F.lit("-"), F.lit(""))
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("bigint").cast("string"), F.lit("/"), bare, F.lit("/"), accession, F.lit("-index.htm"))


def extract_facts(payloads: DataFrame, concepts: tuple[str, ...] = CONCEPTS, payload: str = "payload") -> DataFrame:
    """payloads (company, cik, payload JSON) -> facts of the concepts under us-gaap, one row an entry."""
    parsed = payloads.select("company", "cik", F.from_json(payload, COMPANY_FACTS).alias("p"))
    by_concept = parsed.select("company", "cik", F.explode(F.try_element_at(F.col("p.facts"), F.lit("us-gaap"))).alias("concept", "data"))
    by_unit = by_concept.where(F.col("concept").isin(list(concepts))).select("company", "cik", "concept", F.explode("data.units").alias("unit", "entries"))
    e = by_unit.select("company", "cik", "concept", "unit", F.explode("entries").alias("e"))
    facts = e.select(
        "company", "concept", F.col("e.val").cast("double").alias("value"), "unit",
        fiscal_period(F.col("e.frame"), F.col("e.fy"), F.col("e.fp")).alias("fiscal_period"),
        F.when(F.col("e.start").isNotNull(), "duration").otherwise("instant").alias("period_type"),
        F.col("e.accn").alias("accession_number"), filing_url(F.col("cik"), F.col("e.accn")).alias("source_url"),
        F.col("e.start").alias("period_start"), F.col("e.end").alias("period_end"),
    )
    return facts.withColumn("fact_id", fact_id())


def duplicate_ids(facts: DataFrame) -> DataFrame:
    """(fact_id, n) of ids that several facts share, such as one concept in two units."""
    return facts.groupBy("fact_id").agg(F.count("*").alias("n")).where("n > 1")


def answers_year(year: Column, period_type: str = "period_type", start: str = "period_start", end: str = "period_end") -> Column:
    """Whether a fact states the year's figure: a whole year's span that ends in it, or a December balance."""
    starts, ends = F.col(start).try_cast("date"), F.col(end).try_cast("date")
    spans = F.datediff(ends, starts).between(MIN_DAYS, MAX_DAYS)
    return F.coalesce((F.year(ends) == year) & F.when(F.col(period_type) == "instant", F.month(ends) == 12).otherwise(spans), F.lit(False))


def lookup(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """requests (query_id, concept, company, fiscal_year), each with the fact that answers it, or nulls.

    Of several facts that of the least accession number, as text, then of the least id. How many
    there were is n_facts.
    """
    asked = requests.select("query_id", "concept", "company", "fiscal_year")
    pairs = asked.join(facts, ["concept", "company"]).where(answers_year(F.col("fiscal_year")))
    fields = [c for c in facts.columns if c not in ("concept", "company")]
    best = pairs.groupBy("query_id").agg(F.min_by(F.struct(*fields), F.struct("accession_number", "fact_id")).alias("f"), F.count("*").alias("n_facts"))
    out = asked.join(best, "query_id", "left")
    return out.select("query_id", "concept", "company", "fiscal_year", *(F.col(f"f.{c}").alias(c) for c in fields), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


def formatted(value: str = "value", unit: str = "unit") -> Column:
    """The figure as a filing states it."""
    v, u = F.col(value), F.col(unit)
    # a half goes to the even digit, as the exact value of the double has it
    shown = lambda x, pattern: F.call_function("format_number", x, F.lit(pattern))
    usd = (
        F.when(F.abs(v) >= 1e9, F.concat(F.lit("$"), shown(v / 1e9, "0.00"), F.lit(" billion")))
        .when(F.abs(v) >= 1e6, F.concat(F.lit("$"), shown(v / 1e6, "0.0"), F.lit(" million")))
        .otherwise(F.concat(F.lit("$"), shown(v, "#,##0.00")))
    )
    shares = F.concat(F.lit("$"), shown(v, "0.00"), F.lit(" per share"))
    return F.when(u == "USD", usd).when(u.isin("USD/shares", "USD-per-shares"), shares).otherwise(F.concat(shown(v, "#,##0.00"), F.lit(" "), u))
