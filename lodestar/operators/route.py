"""Rules that send a question to the fact lookup or to the search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import escape, strip

#: Phrases and the concepts they name.
CONCEPT_PHRASES = {
    "net income": "NetIncomeLoss",
    "net loss": "NetIncomeLoss",
    "earnings": "NetIncomeLoss",
    "profit": "NetIncomeLoss",
    "total assets": "Assets",
    "assets": "Assets",
    "total liabilities": "Liabilities",
    "liabilities": "Liabilities",
    "deposits": "Deposits",
    "total deposits": "Deposits",
    "shareholders equity": "StockholdersEquity",
    "shareholders' equity": "StockholdersEquity",
    "stockholders equity": "StockholdersEquity",
    "stockholders' equity": "StockholdersEquity",
    "equity": "StockholdersEquity",
    "basic earnings per share": "EarningsPerShareBasic",
    "diluted earnings per share": "EarningsPerShareDiluted",
    "diluted eps": "EarningsPerShareDiluted",
    "basic eps": "EarningsPerShareBasic",
    "earnings per share": "EarningsPerShareBasic",
    "eps": "EarningsPerShareBasic",
    "net interest income": "InterestIncomeExpenseNet",
    "interest and dividend income": "InterestAndDividendIncomeOperating",
    "interest income": "InterestAndDividendIncomeOperating",
    "provision for loan losses": "ProvisionForLoanAndLeaseLosses",
    "provision for loan and lease losses": "ProvisionForLoanAndLeaseLosses",
    "loans and leases receivable": "LoansAndLeasesReceivableNetReportedAmount",
    "net loans": "LoansAndLeasesReceivableNetReportedAmount",
    "revenue": "RevenueFromContractWithCustomerExcludingAssessedTax",
}
#: Names of companies and their tickers.
COMPANY_PHRASES = {
    "colb": "COLB",
    "columbia": "COLB",
    "columbia banking": "COLB",
    "columbia banking system": "COLB",
    "umpq": "UMPQ",
    "umpqua": "UMPQ",
    "umpqua holdings": "UMPQ",
    "gbci": "GBCI",
    "glacier": "GBCI",
    "glacier bancorp": "GBCI",
    "wsbc": "WSBC",
    "wesbanco": "WSBC",
    "ssb": "SSB",
    "southstate": "SSB",
    "south state": "SSB",
}
#: Wording that asks for an explanation; found inside words too.
NARRATIVE = (
    "why", "how did", "how has", "explain", "describe", "discuss", "risk", "risks", "strategy", "outlook", "compare", "drove", "driver",
    "reason", "impact of", "effect of", "changes in", "what caused",
)
YEAR = r"\b(?:fy\s*)?(19\d{2}|20\d{2})\b"


def longest_first(phrases: dict[str, str]) -> list[tuple[str, str]]:
    """Longest first, equal lengths in the order given: an alternation would take the leftmost instead."""
    return sorted(phrases.items(), key=lambda x: -len(x[0]))


def first_phrase(text: Column, phrases: dict[str, str]) -> Column:
    """(phrase, name) of the first phrase that stands in text as whole words."""
    found = F.lit(None).cast("struct<phrase:string,name:string>")
    for phrase, name in reversed(longest_first(phrases)):
        found = F.when(text.rlike(rf"\b{escape(phrase)}\b"), F.struct(F.lit(phrase).alias("phrase"), F.lit(name).alias("name"))).otherwise(found)
    return found


def classify(queries: DataFrame, text: str = "question") -> DataFrame:
    """queries with route, concept, company, fiscal_year and reasons (the trace of the decision)."""
    low = strip(F.lower(text))
    year = F.regexp_extract(low, YEAR, 1)
    facts = queries.select(
        "*",
        F.get(F.filter(F.array(*map(F.lit, NARRATIVE)), lambda m: F.contains(low, m)), F.lit(0)).alias("_marker"),
        first_phrase(low, CONCEPT_PHRASES).alias("_concept"),
        first_phrase(low, COMPANY_PHRASES)["name"].alias("company_"),
        F.when(year != "", year.cast("int")).alias("fiscal_year"),
    )
    concept, company, marker = F.col("_concept.name"), F.col("company_"), F.col("_marker")
    whole = marker.isNull() & concept.isNotNull() & company.isNotNull() & F.col("fiscal_year").isNotNull()
    trace = F.array(
        F.when(concept.isNotNull(), F.concat(F.lit("concept "), concept, F.lit(" by '"), F.col("_concept.phrase"), F.lit("'"))).otherwise("no concept named"),
        F.when(company.isNotNull(), F.concat(F.lit("company "), company)).otherwise("no company named"),
        F.when(F.col("fiscal_year").isNotNull(), F.concat(F.lit("year "), F.col("fiscal_year").cast("string"))).otherwise("no year named"),
    )
    veto = F.array(F.concat(F.lit("asks for an explanation: '"), marker, F.lit("'")))
    return facts.select(
        *queries.columns,
        F.when(whole, "structured").otherwise("semantic").alias("route"),
        concept.alias("concept"),
        company.alias("company"),
        "fiscal_year",
        F.when(marker.isNotNull(), veto).otherwise(trace).alias("reasons"),
    )


def route_year(text: Column) -> Column:
    year = F.regexp_extract(F.lower(text), YEAR, 1)
    return F.when(year != "", year.cast("int"))
