"""Line-first cleaning: rules on every line, then a verdict on what is left of the document.

Column expressions only; each text is worked on inside its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: White space, symbols and the phrases of boilerplate lines.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
BOILERPLATE = (
    r"(?i)(?:all rights reserved|licensed under|released under|this work is licensed|privacy policy|"
    r"terms of (?:use|service)|cookie policy|uses? cookies|accept (?:all )?cookies|subscribe (?:now|to our)|sign up for|"
    r"log ?in to|click here|read more|enable javascript|share (?:this|on)|follow us|back to top|powered by)"
)
#: A line is navigation from this share of separators among its words.
NAV_SHARE = 0.25
#: A line is noise from this share of symbols among its characters, and shouting from this share of words with !!.
SYMBOL_SHARE, SHOUT_SHARE = 0.10, 0.5
#: Lines of fewer words need no closing punctuation. Lines of more words than LONG_LINE, a parameter of clean_lines, are prose: neither
#: the lack of closing punctuation nor a phrase of boilerplate removes them. A document must keep KEPT_SHARE of its words.
SHORT_LINE, LONG_LINE, KEPT_SHARE = 4, 40, 0.5
MIN_WORDS, MOST_REPEATED = 10, 20
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_kept", "clean_text")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """The number of words in windows of width words that occur twice or more, the first included."""

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))

    def covered(starts: Column) -> Column:
        """starts: ascending starts of repeated windows."""
        first = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(
            starts, first, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last"))
        )["n"]

    def starts(win: Column) -> Column:
        ordered = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def again(s: Column) -> Column:
            def twice(e: Column, k: Column) -> Column:
                before, after = F.get(s, k - 1)["x"] == e["x"], F.get(s, k + 1)["x"] == e["x"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.array_sort(F.transform(F.filter(s, twice), lambda e: e["i"]))

        return let(ordered, again)

    def count(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), 0).otherwise(let(starts(win), covered))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width, 0).otherwise(let(let(hashed, windows), count)).cast("long")


def line_fails(line: Column, long_line: int | None = LONG_LINE) -> Column:
    """Whether a line with a word breaks a rule: noise, shouting, navigation, boilerplate, no closing punctuation. Lines of more
    than long_line words, where there is such a number, break none of the last two.
    """

    def rules(words: Column) -> Column:
        n = F.size(words)
        separators = F.size(F.filter(words, lambda w: w.isin("|", "»", "›", "•", "·", "/", "::", ">")))
        shouts = F.size(F.filter(words, lambda w: F.endswith(w, F.lit("!!"))))
        ends = line.rlike(r"[.!?…。！？:;\"'”’»)\]][\x20\x09-\x0D]*\z")
        phrase = line.rlike(BOILERPLATE) | ((n >= SHORT_LINE) & ~ends)
        return (separators >= NAV_SHARE * n) | (shouts >= SHOUT_SHARE * n) | (phrase if long_line is None else (n <= long_line) & phrase)

    symbols = F.length(F.regexp_replace(line, r"[^#*$%&|<>]+", ""))
    return (symbols >= SYMBOL_SHARE * F.length(line)) | let(words_of(line), rules)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, long_line: int | None = LONG_LINE) -> DataFrame:
    """One row per row of docs: its counts, the cleaned text and the verdict.

    A line of more than long_line words is a paragraph: it goes for noise, shouting or navigation, but neither for lack of
    closing punctuation nor for a phrase that a licence or menu has too. With None all rules hold for all lines.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed describe the whole
    text (null: empty). Lines without a word are left as they are; lines that fail a rule are
    removed. n_lines_removed counts those, n_words_kept the words left, clean_text the text left.
    kept is false where base_failed, or where less than half of the words are left. Null ids and
    repeated rows give results like any other. keep_columns puts the columns of docs first, but for
    those with the name of a result, which are replaced; otherwise only the id is kept.
    """
    text = text_or_empty(text_col)
    others = [F.col(c) for c in docs.columns if c.lower() not in RESULTS or c == id_col] if keep_columns else [F.col(id_col)]
    work = docs.select(F.struct(*others).alias("own"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    left = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(WORD) | ~line_fails(x, long_line))

    def left_over(x: Column) -> Column:
        return F.struct(F.array_join(x, "\n").alias("text"), F.size(F.filter(x, lambda y: y.rlike(WORD))).alias("n"))

    def measured(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"))

    work = work.select(
        "own",
        let(words_of(F.col("text")), measured).alias("w"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        let(left, left_over).alias("left"),
    )
    work = work.select("*", F.size(words_of(F.col("left.text"))).cast("long").alias("n_words_kept"))
    failed = (F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MOST_REPEATED * F.col("w.n_words"))
    return work.select(
        "own.*",
        F.col("w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("n_words_kept") >= KEPT_SHARE * F.col("w.n_words"))).alias("kept"),
        (F.col("lines.n") - F.col("left.n")).cast("long").alias("n_lines_removed"),
        "n_words_kept",
        F.col("left.text").alias("clean_text"),
    )
