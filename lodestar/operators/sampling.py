"""Samples, splits, contamination guards and hard negatives. Every draw is by SHA-256, so it can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.storage import small
from lodestar.functions.text import question_key, regexp_count, text_key

#: Patterns of specific detail, bounds of lengths, shares and thresholds.
DOLLARS = r"(?i)\$\s?[\d,]+(?:\.\d+)?\s*(?:million|billion|thousand)?"
PERCENT, YEARS = r"\d+(?:\.\d+)?\s?%", r"\b(?:19|20)\d{2}\b"
MIN_CANDIDATE, MAX_CANDIDATE, MIN_USABLE = 300, 2500, 200
CONTAMINATION, TEST_SHARE, VALIDATION_SHARE = 0.6, 0.3, 0.1
NAMES = {
    "COLB": "Columbia Banking System",
    "UMPQ": "Umpqua Holdings",
    "GBCI": "Glacier Bancorp",
    "WSBC": "WesBanco",
    "SSB": "South State",
}


def draw(*keys: str) -> Column:
    """The order of a draw: by the digest of a key."""
    return F.sha2(F.concat_ws(":", *(F.col(k).cast("string") for k in keys)), 256)


def specificity(text: str | Column) -> Column:
    return 2 * regexp_count(text, DOLLARS) + 2 * regexp_count(text, PERCENT) + regexp_count(text, YEARS)


def candidates(chunks: DataFrame, strata: list[str], per_stratum: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Of each stratum the most specific texts of a fit length, drawn among the best: (…, score, nth)."""
    fit = chunks.where(F.length(text).between(MIN_CANDIDATE, MAX_CANDIDATE)).withColumn("score", specificity(text))
    best = Window.partitionBy(*strata).orderBy(F.col("score").desc(), F.col(key))
    pool = fit.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max(10 * per_stratum, 20)).drop("_r")
    order = Window.partitionBy(*strata).orderBy(draw(key))
    return pool.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= per_stratum)


def round_robin(chunks: DataFrame, strata: list[str], target: int, key: str = "chunk_id") -> DataFrame:
    """target rows, taken in turns from the strata; strata in the order of their names, rows in that of the draw."""
    order = Window.partitionBy(*strata).orderBy(draw(key))
    nth = chunks.withColumn("nth", F.row_number().over(order).cast("long"))
    # no stratum gives more than target rows, so the window limits each before the global order
    return nth.where(F.col("nth") <= target).orderBy("nth", *strata).limit(target)


def usable(chunks: DataFrame, labelled: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    return chunks.where(F.length(text) >= MIN_USABLE).join(labelled.select(key).distinct(), key, "left_anti")


def labelled_ids(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("relevant_chunk_ids").alias("chunk_id")).distinct()


def contaminated(questions: DataFrame, held_out: DataFrame, key: str = "query_id", text: str = "text", threshold: float = CONTAMINATION) -> DataFrame:
    """questions (key, text) with contaminated: a Jaccard of threshold or more with a held-out text, or no words.

    Two sets of that overlap share one of the first n - ceil(threshold n) + 1 words of each in any one order: here words that no
    held-out text has come first, then those in the fewest. The unknown ones take up places and are never dealt out, so most
    rows have none left to look for; the others meet held-out sets of a like size only.
    """
    held = small(held_out.select(question_key(text).alias("other")).where(F.size("other") > 0).distinct())
    ranks = small(held.select(F.explode("other").alias("w")).groupBy("w").agg(F.count("*").alias("texts")))
    most = lambda n: (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int")

    def known(df: DataFrame, words: str, *by: str) -> DataFrame:
        """(by, n, known): the size of a set, and its words that are known in their order."""
        each = df.select(*by, F.size(words).alias("n"), F.explode(words).alias("w")).join(ranks, "w")
        return each.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("texts", "w")))["w"].alias("known"))

    own = questions.select(key, question_key(text).alias("own")).withColumn("set", F.xxhash64("own"))
    a = known(own, "own", key, "set").withColumn("left", most(F.col("n")) - (F.col("n") - F.size("known"))).where("left > 0")
    a = a.select(key, F.col("n").alias("a_n"), F.col("known").alias("a_known"), F.explode(F.slice("known", F.lit(1), F.col("left"))).alias("w"))
    b = known(held.withColumn("id", F.xxhash64("other")), "other", "id")
    b = b.select(F.col("n").alias("b_n"), F.col("known").alias("b_known"), F.explode(F.slice("known", F.lit(1), most(F.col("n")))).alias("w"))
    sizes = (F.col("b_n") >= threshold * F.col("a_n") - 1e-9) & (F.col("a_n") >= threshold * F.col("b_n") - 1e-9)
    both = F.size(F.array_intersect("a_known", "b_known"))
    pairs = a.join(small(b), "w").where(sizes & (both / (F.col("a_n") + F.col("b_n") - both) >= threshold))
    flagged = own.where(F.size("own") == 0).select(key).union(pairs.select(key)).distinct().withColumn("_f", F.lit(True))
    return questions.join(flagged, key, "left").withColumn("contaminated", F.coalesce("_f", F.lit(False))).drop("_f")


def leaked(training: DataFrame, held_out: DataFrame, text: str = "text") -> DataFrame:
    """The training texts whose word set is that of a held-out one; there must be none."""
    keys = held_out.select(question_key(text).alias("k")).where(F.size("k") > 0).distinct()
    return training.withColumn("k", question_key(text)).join(keys, "k", "left_semi").drop("k")


def require_no_leak(training: DataFrame, held_out: DataFrame, text: str = "text") -> int:
    """The number of held-out word sets; an error if training has one of them."""
    if n := leaked(training, held_out, text).count():
        raise ValueError(f"{n} held-out questions are among the training data")
    return held_out.select(question_key(text).alias("k")).distinct().count()


def with_company_names(text: str | Column) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for ticker, name in NAMES.items():
        out = F.regexp_replace(out, rf"(?i)\b{ticker}\b", name)
    return out


def negatives(ranked: DataFrame, positives: DataFrame, n: int = 4, skip_top: int = 0, also_exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, nth): hard negatives of each query, from its ranked candidates.

    ranked (query_id, chunk_id, text, rank); positives (query_id, chunk_id, text). The positive goes
    by id and by text key, as do further known answers (query_id, text); empty texts go; of equal
    texts the first stays; skip_top counts the survivors.
    """
    found = ranked.withColumn("_k", text_key("text")).where("_k <> ''").join(positives.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    barred = positives.select("query_id", text_key("text").alias("_k"))
    if also_exclude is not None:
        barred = barred.unionByName(also_exclude.select("query_id", text_key("text").alias("_k")))
    found = found.join(barred.where("_k <> ''").distinct(), ["query_id", "_k"], "left_anti")
    same = Window.partitionBy("query_id", "_k").orderBy("rank")
    order = Window.partitionBy("query_id").orderBy("rank")
    first = found.withColumn("_d", F.row_number().over(same)).where("_d = 1").withColumn("nth", F.row_number().over(order).cast("long") - skip_top)
    return first.where(F.col("nth").between(1, n)).select("query_id", "chunk_id", "rank", "nth")


def triplets(chosen: DataFrame, positives: DataFrame, corpus: DataFrame) -> DataFrame:
    """Training triplets with texts: positives (query_id, query, chunk_id). Contradictions are for contradictory() to find."""
    texts = corpus.select("chunk_id", "text")
    out = chosen.select("query_id", F.col("chunk_id").alias("negative_chunk_id")).join(positives.select("query_id", "query", F.col("chunk_id").alias("positive_chunk_id")), "query_id")
    out = out.join(texts.select(F.col("chunk_id").alias("positive_chunk_id"), F.col("text").alias("positive")), "positive_chunk_id")
    return out.join(texts.select(F.col("chunk_id").alias("negative_chunk_id"), F.col("text").alias("negative")), "negative_chunk_id").where("positive <> ''")


def contradictory(rows: DataFrame) -> DataFrame:
    """Triplets whose negative is a positive of the same query, by text; there must be none."""
    good = rows.select("query", text_key("positive").alias("_k")).distinct()
    return rows.withColumn("_k", text_key("negative")).join(good, ["query", "_k"], "left_semi").drop("_k")


def split_queries(rows: DataFrame, query: str = "query", share: float = VALIDATION_SHARE) -> DataFrame:
    """rows with split: the first tenth of the queries, one at least, in the order of the draw, are val; the rest train.

    A query's rows stay together. Counts per query are ranked, not rows.
    """
    names = rows.select(query).distinct().withColumn("_h", draw(query))
    n = names.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("n"))
    return rows.join(first_drawn(names, n).select(query, F.when(F.col("drawn"), "val").otherwise("train").alias("split")), query)


def first_drawn(names: DataFrame, n: DataFrame, *by: str) -> DataFrame:
    """names (…, _h a hex digest) with drawn: whether _h is among the n smallest of its group by. No group is sorted in one task.

    n: (by, n). A histogram over the first four digits, of 65536 rows a group at most, finds the
    bucket in which the n-th lies; only rows of that bucket are ranked.
    """
    names = names.withColumn("_b", F.substring("_h", 1, 4))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = names.groupBy(*by, "_b").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(upto))
    histogram = histogram.join(small(n), list(by)) if by else histogram.crossJoin(F.broadcast(n))
    buckets = histogram.select(*by, "_b", (F.col("_upto") <= F.col("n")).alias("_all"), (F.col("n") - F.col("_upto") + F.col("_c")).alias("_left"))
    marked = names.join(small(buckets), [*by, "_b"])
    edge = marked.where(~F.col("_all") & (F.col("_left") > 0)).withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h")))
    edge = edge.withColumn("drawn", F.col("_i") <= F.col("_left")).drop("_i")
    rest = marked.where(F.col("_all") | (F.col("_left") <= 0)).withColumn("drawn", F.col("_all"))
    return edge.unionByName(rest).drop("_b", "_all", "_left")


def assign_splits(entries: DataFrame, strata: list[str], key: str = "eval_id", share: float = TEST_SHARE) -> DataFrame:
    """entries (key, strata, verified, split) with split filled: rows that have one keep it, unverified ones go to dev.

    Of each stratum's verified rows the share, rounded half to even, is test, drawn by the key's
    digest among those without a split; a value that is no split is an error.
    """
    known = F.when(F.col("split").isNull() | F.col("split").isin("dev", "test"), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("no such split: "), F.col("split"))))
    # a stratum's name as one text, in which nulls have a place
    rows = entries.withColumn("split", known).withColumn("_s", F.to_json(F.struct(*strata)))
    is_free = F.col("verified") & F.col("split").isNull()
    target = F.bround(F.count_if("verified") * F.lit(share)) - F.count_if(F.col("verified") & (F.col("split") == "test"))
    free = rows.where(is_free).withColumn("_h", F.sha2(F.col(key).cast("string"), 256))
    drawn = first_drawn(free, rows.groupBy("_s").agg(target.alias("n")), "_s")
    chosen = drawn.withColumn("split", F.when(F.col("drawn"), "test").otherwise("dev")).select(*rows.columns)
    rest = rows.where(~F.coalesce(is_free, F.lit(False))).withColumn("split", F.coalesce("split", F.lit("dev")))
    return chosen.unionByName(rest).drop("_s")


def unseen(hits: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """The first n hits of each query that no label has: what a reviewer should look at."""
    left = hits.join(labels.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank")
    return left.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= n)


def reviewed(markdown: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, eval_id, picks): the ids ticked under each heading of a review sheet, in order; ticks under no heading go."""
    lines = markdown.select(doc, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^###\s+`([^`]+)`", 1)
    tick = F.regexp_extract(F.trim("line"), r"^-\s*\[[xX]\]\s*`([0-9a-f]+)`", 1)
    so_far = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = lines.select(doc, "pos", F.last(F.when(head != "", head), ignorenulls=True).over(so_far).alias("eval_id"), F.when(tick != "", tick).alias("pick"))
    got = filled.where("eval_id is not null").groupBy(doc, "eval_id").agg(F.array_sort(F.collect_list(F.when(F.col("pick").isNotNull(), F.struct("pos", "pick")))).alias("p"))
    return got.select(doc, "eval_id", F.transform("p", lambda x: x["pick"]).alias("picks"))


def apply_review(entries: DataFrame, picks: DataFrame, offered: DataFrame) -> DataFrame:
    """entries (eval_id, relevant_chunk_ids) widened by the picks that were offered, new ones last: (…, n_added, rejected)."""
    out = entries.join(picks.select("eval_id", "picks"), "eval_id", "left").join(offered.select("eval_id", "offered"), "eval_id", "left")
    none = F.array().cast("array<string>")
    p, o = F.coalesce("picks", none), F.coalesce("offered", none)
    new = F.filter(p, lambda x: F.array_contains(o, x) & ~F.array_contains(F.col("relevant_chunk_ids"), x))
    out = out.select(*entries.columns, new.alias("_new"), F.filter(p, lambda x: ~F.array_contains(o, x)).alias("rejected"))
    widened = F.concat("relevant_chunk_ids", "_new").alias("relevant_chunk_ids")
    return out.select(*(widened if c == "relevant_chunk_ids" else F.col(c) for c in entries.columns), F.size("_new").alias("n_added"), "rejected")


def manifest_problems(listed: DataFrame, present: DataFrame) -> DataFrame:
    """(path, problem): files missing, unexpected or of another digest; an empty list is a problem of its own."""
    a = listed.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.col("sha256").alias("want"))
    both = a.join(present.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.col("sha256").alias("have")), "path", "full")
    found = both.select("path", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "mismatch").alias("problem"))
    empty = a.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("path"), F.lit("empty manifest").alias("problem"))
    return found.where("problem is not null").unionByName(empty)

