"""Text around a model call: prompts, citations, refusals, replies. The call itself is a provider's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import let, strip

#: The refusal, and the passages given at most.
REFUSAL = "The provided filings do not state this."
MOST_PASSAGES = 6
INSTRUCTION = (
    "You answer questions about the filings of banks from numbered passages.\n\n"
    "Use the passages alone. After each fact give the number of its passage in square brackets, such as [1] or [2][3]. Give figures "
    f'as they are written. If the passages lack the answer, reply exactly: "{REFUSAL}" Be brief.\n'
)
MIN_QUESTION = 15
PREAMBLES = ("here are", "sure", "questions:")


def prompt(question: str = "question", passages: str = "passages") -> Column:
    """passages: array<struct<company, filing_type, filing_date, section, text>>, numbered from 1."""

    def block(p: Column, i: Column) -> Column:
        known = [F.coalesce(p[f].cast("string"), F.lit("?")) for f in ("company", "filing_type", "filing_date")]
        head = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), known[0], F.lit(" "), known[1], F.lit(" filed "), known[2])
        section = F.when(F.coalesce(p["section"], F.lit("")) != "", F.concat(F.lit(" — "), p["section"])).otherwise("")
        return F.concat(head, section, F.lit("\n"), strip(F.coalesce(p["text"], F.lit(""))))

    blocks = F.array_join(F.transform(passages, block), "\n\n")
    return F.concat(F.lit(f"{INSTRUCTION}\n--- PASSAGES ---\n\n"), blocks, F.lit("\n\n--- QUESTION ---\n"), F.col(question), F.lit("\n\n--- ANSWER ---\n"))


def cited(answer: str | Column, n_passages: str | Column) -> Column:
    """Numbers of the passages cited, in order of first mention; numbers of no passage go."""
    answer, n = (F.col(c) if isinstance(c, str) else c for c in (answer, n_passages))
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n)))


def citations(answer: str, passages: str) -> Column:
    return F.transform(cited(answer, F.size(passages)), lambda i: F.element_at(F.col(passages), i))


def is_refusal(answer: str | Column) -> Column:
    answer = F.col(answer) if isinstance(answer, str) else answer
    return F.contains(F.lower(answer), F.lit(REFUSAL.lower().rstrip(".")))


def answers(questions: DataFrame, generate) -> DataFrame:
    """questions (…, question, passages) with answer, refused, citations. Without passages the model isn't asked.

    generate: a function of (DataFrame with prompt) that adds answer.
    """
    asked = questions.withColumn("passages", F.slice(F.coalesce("passages", F.array()).cast(questions.schema["passages"].dataType), 1, MOST_PASSAGES))
    empty = asked.where(F.size("passages") == 0).withColumns({"prompt": F.lit(None).cast("string"), "answer": F.lit(REFUSAL)})
    full = generate(asked.where(F.size("passages") > 0).withColumn("prompt", prompt()))
    out = full.unionByName(empty)
    return out.withColumns({"refused": is_refusal("answer"), "citations": citations("answer", "passages")})


def without_reasoning(text: str | Column) -> Column:
    """Less closed reasoning blocks, then all up to a stray end tag. An opening tag that never ends stays."""
    text = F.col(text) if isinstance(text, str) else text
    cut = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return strip(F.when(F.contains(cut, F.lit("</think>")), F.regexp_replace(cut, r"(?is)\A.*?</think>", "")).otherwise(cut))


def questions_in(reply: str | Column, most: int = 3) -> Column:
    """The questions of a model's reply, one a line, without enumeration and quotes, each once."""
    reply = F.col(reply) if isinstance(reply, str) else reply

    def clean(line: Column) -> Column:
        bare = strip(F.regexp_replace(line, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))
        return F.btrim(bare, F.lit('"'))

    def good(q: Column) -> Column:
        starts = F.lit(False)
        for p in PREAMBLES:
            starts = starts | F.startswith(F.lower(q), F.lit(p))
        return F.endswith(q, F.lit("?")) & (F.length(q) >= MIN_QUESTION) & ~starts

    lines = F.transform(F.split(reply, r"\r\n|[\n\r]"), clean)
    return F.slice(F.array_distinct(F.filter(lines, good)), 1, most)


GENERATION_PROMPT = (
    "Write {n} different questions that the passage below answers, as someone who studies banks would ask them of a search engine.\n\n"
    "The passage alone must be enough to answer each. Name the company or the subject; don't speak of the passage or the document. "
    "Use your own words. Give one question a line, without numbers or remarks.\n\n"
)


def question_prompt(n: int = 3) -> Column:
    known = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("company", "filing_type", "filing_date")]
    head = F.concat(F.lit("--- PASSAGE ("), known[0], F.lit(" "), known[1], F.lit(" filed "), known[2], F.lit(") ---\n"))
    return F.concat(F.lit(GENERATION_PROMPT.replace("{n}", str(n))), head, strip(F.coalesce("text", F.lit(""))), F.lit("\n\n--- QUESTIONS ---\n"))


def verdict(reply: str | Column) -> Column:
    """struct(total_claims, supported_claims, support_rate, unsupported, judge_error) of a judge's reply.

    Markdown fences go first. A reply that is no JSON object has judge_error alone.
    """
    reply = F.col(reply) if isinstance(reply, str) else reply
    fenced = F.get(F.split(reply, "```"), F.lit(1))
    bare = F.when(F.startswith(reply, F.lit("```")), F.regexp_replace(fenced, r"\Ajson", "")).otherwise(reply)
    schema = "total_claims double, supported_claims double, unsupported array<string>, _corrupt_record string"

    def read(v: Column) -> Column:
        total, good = (F.coalesce(v[c], F.lit(0.0)).cast("int") for c in ("total_claims", "supported_claims"))
        bad = v.isNull() | v["_corrupt_record"].isNotNull()
        fields = {
            "total_claims": total,
            "supported_claims": good,
            "support_rate": F.try_divide(good.cast("double"), total.cast("double")),
            "unsupported": F.coalesce(v["unsupported"], F.array().cast("array<string>")),
        }
        empty = [F.when(~bad, c).alias(n) for n, c in fields.items()]
        return F.struct(*empty, F.when(bad, "unparseable").alias("judge_error"))

    parsed = F.from_json(strip(bare), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return let(parsed, read)


def is_transient(error: str) -> Column:
    """A failure worth a retry: overload, but not a quota that is used up."""
    has = lambda *marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(F.col(error), m))
    return ~has("429", "RESOURCE_EXHAUSTED", "quota") & has("503", "UNAVAILABLE", "500", "INTERNAL", "deadline", "timeout")
