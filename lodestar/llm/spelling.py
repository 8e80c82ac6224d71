"""Spelling variants: words one edit apart, found by equal bands of the parities of their letters, and the form each comes from.

Column expressions, aggregates and joins only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, small, text_or_empty

#: Of 97 occurrences one loses a letter, by hash; words have LEAST_LETTERS at least and occur LEAST_TIMES.
ONE_IN, LEAST_LETTERS, LEAST_TIMES = 97, 5, 3
#: Letters share BITS parities; consecutive letters are in different bands.
BITS, BANDS = 63, 3
BAND = [sum(1 << i for i in range(BITS) if i % BANDS == b) for b in range(BANDS)]
#: Keys of two words of one length, and of a word and one of a letter more: (band, whether the end of the word is meant). Two flipped
#: bits leave one of three bands as it is, one flipped bit one of two.
SAME, LONGER = ([(b, end) for b in range(n) for end in (False, True)] for n in (BANDS, BANDS - 1))
#: Words of a band's bucket that one task compares with those on the other side; larger buckets are dealt out.
CELL = 2_000
#: A form has so many times the occurrences of a word at least, so that forms of forms come to an end.
RATIO = 2


def occurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): the runs of letters, A-Z in lower case. One occurrence in ONE_IN, by the hash of id and run, has lost a letter."""
    lower = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = each.select(F.when(F.pmod("h", F.lit(ONE_IN)) == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)


def parities(word: Column) -> Column:
    """A bit for each letter, set where the word has an odd number of it. A letter put in or left out flips one, another in its place two at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(BITS)))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: F.when(c == "", mask).otherwise(mask.bitwiseXOR(bit(c))))


def half(word: Column, size: Column, shorter: Column, end: bool) -> Column:
    """The first half of a word, or the rest, as long as in the shorter of two: one edit leaves one of these as it is."""
    first = F.floor(shorter / 2).cast("int")
    return F.substring(word, size - shorter + first + 1, shorter) if end else F.substring(word, F.lit(1), first)


def keys(pairs: list[tuple[int, bool]], shorter: Column, start: int) -> list[Column]:
    """Hashes that two words one edit apart share one of: a band of their bits, the length of the shorter, and a half of the letters."""
    word, size = F.col("word"), F.col("size")
    return [F.xxhash64(F.lit(start + i), shorter, F.col("mask").bitwiseAND(F.lit(BAND[b]).cast("long")), half(word, size, shorter, end)) for i, (b, end) in enumerate(pairs)]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): of words (word, n) each pair one inserted, deleted or replaced letter apart, both ways.

    A replaced letter flips two bits at most and one letter more flips one, so some band is equal. Words are joined on a band,
    their length and the half of the word that the edit isn't in, which keeps buckets small where many words have the same few
    letters. Buckets over CELL are dealt into cells, so none is one task's. Of a pair two bits differ at most, and the words
    themselves are one edit apart; it is taken for the first key that they share.
    """
    masks = cut(words.select("word", "n", F.length("word").alias("size"), parities(F.col("word")).alias("mask")), "letter-parities")
    size, tags = F.col("size"), [*SAME, *LONGER]
    spread = lambda longer: F.posexplode(F.array(*keys(SAME, size, 0), *keys(LONGER, size - longer, len(SAME)))).alias("tag", "key")
    held, asks = (masks.select("word", "n", "size", "mask", spread(longer)) for longer in (1, 0))
    large = held.groupBy("key").agg(F.count("*").alias("of")).where(F.col("of") > CELL)
    large = small(large.select("key", F.ceil(F.col("of") / CELL).cast("int").alias("cells")))
    cells = F.coalesce("cells", F.lit(1))
    held = held.join(large, "key", "left").select("key", F.pmod(F.xxhash64("word"), cells).cast("int").alias("cell"), *(F.col(c).alias(f"r_{c}") for c in ("word", "n", "size", "mask")))
    asks = asks.join(large, "key", "left").select("key", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"), "tag", *(F.col(c).alias(f"l_{c}") for c in ("word", "n", "size", "mask")))
    flipped, longer = F.col("l_mask").bitwiseXOR(F.col("r_mask")), F.col("l_size") < F.col("r_size")

    def shared(i: int) -> Column:
        b, end = tags[i]
        ends = (half(F.col(f"{p}_word"), F.col(f"{p}_size"), F.col("l_size"), end) for p in "lr")
        return (longer == F.lit(i >= len(SAME))) & (flipped.bitwiseAND(F.lit(BAND[b]).cast("long")) == 0) & (next(ends) == next(ends))

    first = reduce(lambda rest, i: F.when(shared(i), i).otherwise(rest), reversed(range(len(tags))), F.lit(-1))
    close = F.when(longer, F.bit_count(flipped) <= 1).otherwise((F.bit_count(flipped) <= 2) & (F.col("l_word") < F.col("r_word")))
    one = F.call_function("levenshtein", F.col("l_word"), F.col("r_word"), F.lit(1)) == 1
    pairs = asks.join(held, (asks["key"] == held["key"]) & (asks["cell"] == held["cell"]) & close & one & (first == F.col("tag")))
    pairs = cut(pairs.select("l_word", "l_n", "r_word", "r_n"), "near-words")
    drop(words.sparkSession, masks, large)
    names = ["word", "n", "near", "near_n"]
    return pairs.toDF(*names).union(pairs.select("r_word", "r_n", "l_word", "l_n").toDF(*names))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms of forms. Each round doubles the steps that have been followed."""
    at = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs with least_letters letters and least_times occurrences.

    A word's form is the near word of most occurrences, ties by code points, if it has RATIO times those of the word at least;
    its root is where forms of forms end, the word itself if it has none.

    Null and empty texts have no words, and an empty table gives an empty one; texts of any length and repeated rows count
    whole; a null id takes part as an empty one. Other columns of docs aren't looked at, and may have any name.
    """
    words = cut(occurring(docs, id_col, text_col, least_letters, least_times), "words")
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    near = near.withColumn("form_n", F.negative("best.col1"))
    larger = F.col("form_n") >= RATIO * F.col("n")
    near = cut(near.select("word", "n_near", F.when(larger, F.col("best.near")).alias("form"), F.when(larger, F.col("form_n")).alias("form_n")), "forms")
    out = words.join(near, "word", "left").join(roots(near.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
