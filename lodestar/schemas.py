"""Record types: every reader names its schema, none is inferred. Types are in DDL, so that no session is needed to import them."""

CHUNK = (
    "company string, filing_type string, filing_date string, accession_number string, source_url string, chunk_type string, "
    "hierarchy_level int, parent_chunk_id string, chunk_index int, section string, text string, chunk_id string, token_count int"
)
TABLE_CHUNK = CHUNK + ", rows array<array<string>>"
FACT = (
    "company string, concept string, value double, unit string, fiscal_period string, period_type string, "
    "accession_number string, source_url string, period_start string, period_end string, fact_id string"
)
EVAL_ENTRY = (
    "eval_id string, question string, relevant_chunk_ids array<string>, question_type string, company string, filing_type string, "
    "filing_date string, chunk_type string, source_url string, drafted_by string, verified boolean, verification_note string, split string"
)
RANKED = ("query_id string, retriever string, rank long, chunk_id string, score double")
SYNTHETIC_QUERY = ("query string, chunk_id string, company string, chunk_type string, filing_type string, generated_by string")
TRIPLET = (
    "query string, positive_chunk_id string, negative_chunk_id string, company string, chunk_type string, positive string, negative string"
)
COMPANY_FACTS = (
    "cik bigint, entityName string, facts map<string, map<string, struct<units: map<string, array<struct<"
    "start: string, end: string, val: double, accn: string, fy: bigint, fp: string, form: string, filed: string, frame: string>>>>>>"
)
SUBMISSIONS = (
    "filings struct<recent: struct<form: array<string>, filingDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>>"
)
