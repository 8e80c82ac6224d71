"""Personal data: pattern spans, and the terms that corpus co-occurrence shows to reveal them.

Column expressions and joins only. A term's disclosure of an entity is their pointwise mutual
information over the entity's own information, log(N n(e,t) / (n(e) n(t))) / log(N / n(e)), where
n counts the distinct lines of the corpus: 1 for a term that never stands without the entity.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, small, text_or_empty

#: Kinds of spans in their order. The last two are terms.
KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
#: The patterns asked for, written so that a failing place is left at once: no start inside a run of their characters,
#: but where the last match ended, and no step back inside a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: What a text must hold for a pattern to match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Lines that an entity and a term must share before they tell anything, and disclosures from which terms go.
LEAST_LINES, GENERALISE, REMOVE = 2, 0.85, 0.95
LEAST_LETTERS = 3
TRIM = ".,;:!?()[]{}\"'<>|*#$%&=/\\-_+~`"
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
BLOCK = 256
#: Of so many parts of the lines one gives the first bounds.
PARTS = 32


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def sums_before(values: Column) -> Column:
    """For each of values the sum of those before it, by blocks, so that no long prefix is added up again and again."""

    def by_block(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

        def placed(s: Column) -> Column:
            heads = F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
            return let(heads, lambda h: F.transform(v, lambda _, i: F.get(h, F.floor(i / BLOCK).cast("int")) + total(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

        return let(blocks, placed)

    return let(values, by_block)


def found(text: Column, pattern: str) -> Column:
    """(start, end, value) of the pattern's matches, in code points. The text has one at least."""

    def spans(both: Column) -> Column:
        gaps, values = both["gaps"], both["values"]
        steps = F.zip_with(gaps, values, lambda g, v: F.length(g) + F.length(F.coalesce(v, F.lit(""))))

        def span(v: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))

        return let(sums_before(steps), lambda before: F.transform(values, lambda v, i: span(v, i, before)))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return let(both, spans)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(value: Column) -> Column:
    def check(d: Column) -> Column:
        backwards = F.transform(F.split(F.reverse(d), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
        doubled = F.transform(backwards, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
        return total(doubled) % 10 == 0

    return let(digits(value), check)


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


NO_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """(start, kind, end, value) of a kind; matches that fail are dropped without a retry."""
    place = KINDS.index(kind)
    kept = F.filter(found(text, PATTERNS[kind]), lambda s: passes(kind, s["value"]))
    spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    may = text.rlike(PATTERNS[kind])
    if NEEDS[kind]:
        may = text.contains(NEEDS[kind]) & may
    return F.when(may, spans).otherwise(F.array()).cast(NO_SPANS)


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def term(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(TRIM))


def is_term(t: Column) -> Column:
    return (F.length(t) >= LEAST_LETTERS) & ~t.rlike(r"[0-9@]")


def entities_of(lines: DataFrame) -> DataFrame:
    """(line, entity) of the lines (line, text)."""
    out = None
    for kind in PATTERNS:
        values = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        one = lines.where(F.col("text").rlike(PATTERNS[kind])).select("line", F.explode(F.array_distinct(values)).alias("value")).where(passes(kind, F.col("value")))
        one = one.select("line", F.xxhash64(F.concat(F.lit(f"{kind}:"), F.lower("value"))).alias("entity"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def outside(text: Column) -> Column:
    """The text with a space in the place of each entity."""

    def without(kind: str, t: Column) -> Column:
        def joined(b: Column) -> Column:
            return F.array_join(F.zip_with(b["gaps"], b["values"], lambda g, v: F.concat(g, F.when(v.isNull(), "").when(passes(kind, v), " ").otherwise(v))), "")

        both = F.struct(F.split(t, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)).alias("values"))
        may = t.rlike(PATTERNS[kind])
        if NEEDS[kind]:
            may = t.contains(NEEDS[kind]) & may
        return F.when(may, let(both, joined)).otherwise(t)

    for kind in PATTERNS:
        text = let(text, partial(without, kind))
    return text


def same_lines() -> list[Column]:
    """A fingerprint of a group's distinct lines, added up, so that no group is gathered."""
    return [F.count("*").alias("n"), F.sum(F.xxhash64("line").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("line", F.lit(1))).alias("x")]


def disclosing_terms(source: DataFrame, known: DataFrame) -> DataFrame:
    """(term, disclosure), of the entity that it discloses most, from the texts of the corpus and those that hold an entity.

    Entities that stand in the same lines are one class, and so are terms that stand in the same
    lines of entities and in as many of the corpus: a line of many entities and terms that recurs
    gives one pair of classes. A term that stands in more lines than its largest class of entities
    allows goes before pairs are made.
    """

    def lines(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.split("text", "\n")).alias("text")).select(F.xxhash64("text").alias("line"), "text")

    near = cut(entities_of(lines(known)), "entity-lines")
    of_entity = near.groupBy("entity").agg(*same_lines()).where(F.col("n") >= LEAST_LINES)
    of_entity = cut(of_entity.select("entity", F.xxhash64("n", "s", "x").alias("class"), F.col("n").alias("n_e")), "entity-classes")
    at = cut(near.join(small(of_entity), "entity").select("class", "line", "n_e").distinct(), "class-lines")
    n = lines(source).select("line").distinct().count()

    def most(together: Column) -> Column:
        """The most lines that a term can stand in and still disclose the entity enough."""
        return together * F.pow(F.lit(float(max(n, 1))) / F.col("n_e"), F.lit(1 - GENERALISE)) + 1e-6

    reach = at.groupBy("line").agg(F.max(most(F.col("n_e"))).alias("reach"))
    texts = lines(known).join(small(reach), "line").groupBy("line").agg(F.first("text").alias("text"), F.first("reach").alias("reach"))
    words = F.array_distinct(F.filter(F.transform(F.split(outside(F.col("text")), SPACE), term), is_term))
    words = cut(texts.select("line", "reach", F.explode(words).alias("term")), "context-words")
    terms = words.groupBy("term").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).where(F.col("n") >= LEAST_LINES)
    terms = cut(terms.select("term", "reach"), "context-terms")

    def occurrences(terms: DataFrame, some: Column) -> DataFrame:
        """(term, n_t): in how many of some distinct lines each of terms stands."""
        words = lines(source).where(some).select("line", F.explode(F.split(outside(F.col("text")), SPACE)).alias("word"))
        words = words.select("line", term(F.col("word")).alias("term")).join(small(terms), "term")
        return words.distinct().groupBy("term").agg(F.count("*").alias("n_t"))

    # counts over a part of the lines are bounds from below: they rule out the common words, and
    # with them most of the rows to deal out, before the others are counted over all lines
    below = occurrences(terms.select("term"), F.pmod("line", F.lit(PARTS)) == 0).withColumnRenamed("n_t", "low")
    terms = cut(terms.join(below, "term", "left").where(F.coalesce("low", F.lit(0)) <= F.col("reach")).drop("low"), "rare-terms")
    of_term = cut(terms.join(occurrences(terms.select("term"), F.lit(True)), "term").where(F.col("n_t") <= F.col("reach")).select("term", "n_t"), "term-counts")
    words = cut(words.join(small(of_term), "term").select("term", "line", "n_t"), "rare-words")
    of_term = words.groupBy("term", "n_t").agg(*same_lines())
    of_term = cut(of_term.select("term", "n_t", F.xxhash64("n", "s", "x", "n_t").alias("set")), "term-classes")
    sets = words.join(small(of_term.select("term", "set")), "term").select("set", "line", "n_t").distinct()
    pairs = sets.join(at, "line").where(F.col("n_t") <= most(F.col("n_e"))).groupBy("class", "set", "n_e", "n_t").agg(F.count("*").alias("n_et"))
    pairs = pairs.where((F.col("n_et") >= LEAST_LINES) & (F.col("n_t") <= most(F.col("n_et"))) & (F.col("n_e") < n))
    information = F.log2(F.lit(float(n)) / F.col("n_e"))
    shared = F.log2(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    pairs = cut(pairs.select("class", "set", (shared / information).alias("disclosure")).where(F.col("disclosure") >= GENERALISE), "class-pairs")
    best = pairs.groupBy("set").agg(F.max("disclosure").alias("disclosure"))
    return best.join(of_term, "set").select("term", "disclosure")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, sanitised).

    spans joins kind:start:end, in code points, by start and kind. Beside the pattern kinds it has,
    in every text, the words that disclose an entity of the corpus: remove where nearly nothing
    else is said with them, generalise below that. sanitised is the text with spans replaced, null where
    there are none. A null text counts as empty; null ids stay null; repeated rows give repeated
    results. Other columns are ignored. Without entities that recur nothing is disclosed.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    own = source.select("id", "text", *(spans_of(F.col("text"), k).alias(k) for k in PATTERNS))
    own = own.select(
        "id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.array_sort(F.concat(*(F.col(k) for k in PATTERNS))).alias("base"),
        "text",
    )
    own = own.withColumn("key", F.xxhash64("id", "text")).withColumn("text", F.when(F.size("base") > 0, F.col("text")))
    own = cut(own, "pattern-spans")
    telling = disclosing_terms(source, own.where("text is not null").select("text"))
    telling = small(telling.select("term", F.when(F.col("disclosure") >= REMOVE, 4).otherwise(5).alias("kind")))

    # texts that say a term, whether or not they hold an entity
    keyed = source.select(F.xxhash64("id", "text").alias("key"), "text")
    words = keyed.select("key", F.explode(F.split(F.lower("text"), SPACE)).alias("word")).select("key", F.btrim("word", F.lit(TRIM)).alias("term"))
    told = words.join(telling, "term").distinct().groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("told"))
    told = cut(told, "told")
    texts = keyed.join(small(told.select("key")), "key").groupBy("key").agg(F.first("text").alias("whole"))
    out = own.join(told.join(texts, "key"), "key", "left").withColumn("text", F.coalesce("text", "whole"))

    def marked(words: Column) -> Column:
        def span(w: Column) -> Column:
            kind = F.element_at(F.col("told"), term(w["value"]))
            lead = F.length(w["value"]) - F.length(F.ltrim(w["value"], F.lit(TRIM)))
            start = w["start"] + lead
            return F.struct(start.alias("start"), kind.alias("kind"), (start + F.length(F.btrim(w["value"], F.lit(TRIM)))).alias("end"), w["value"].alias("value"))

        return F.filter(F.transform(words, span), lambda s: s["kind"].isNotNull())

    more = F.when(F.col("told").isNotNull(), marked(found(F.col("text"), WORD))).otherwise(F.array()).cast(NO_SPANS)
    out = out.withColumn("spans", F.array_sort(F.concat("base", more)))
    return out.select(
        F.col("id").alias(id_col),
        *(f"n_{k}" for k in PATTERNS),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"))).alias("sanitised"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span's mark in its place; overlapping spans become one, with the first one's mark."""
    marks = F.array(*(F.lit(m) for m in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[TERM]")))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        out = F.when(apart, F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(marks, s["kind"]))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
