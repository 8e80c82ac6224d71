"""Fuzzy line deduplication: SimHashes of lines and of their blocks, pigeonhole joins, edit similarity, connected groups.

Column expressions, aggregates and joins only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import linked
from .shared import cut, drop, fresh, small, text_or_empty

#: Lines link whose edit similarity, in words, is SIMILARITY at least. The 64-bit SimHashes of lines of which a fifth of the
#: words differ are some 13 bits apart, with a deviation of 3: one in twenty of these are beyond DISTANCE bits, and not compared.
SIMILARITY, DISTANCE = 0.8, 16
#: A block is a word that comes before all within REACH places of it in the order of place_of, with those words. A word
#: edited changes the blocks that hold it and no other, so by the pigeonhole principle some block of a line stays.
REACH = 2
#: Of the blocks of a line of n words a share of DENSE / n is taken, by hash, so that a long line has some eight of them.
DENSE, SHARES = 40, 1 << 20
#: Lines of more words than DENSE, of whose blocks only a share is taken, have keys by their SimHash as well. It is cut into PARTS
#: blocks of bits: by the pigeonhole principle PARTS - NEAR of these are equal in any two that are within NEAR bits.
NEAR, PARTS = 3, 6
#: Lines of so many words are cut in halves as well: of any two that differ in one word, one half stays as it is.
SHORT = 10
#: A line of fewer words is within SIMILARITY of equal ones only, and has no keys.
LEAST = 4
#: What stands beyond an end of the line, by its distance: farther off the complement, which cancels the nearer one.
BEYOND = {-2: ~0x5851F42D4C957F2D, -1: 0x5851F42D4C957F2D, 1: 0x14057B7EF767814F, 2: ~0x14057B7EF767814F}
BITS, LANES = 64, 2
#: Words whose hashes counted() adds up at a time.
SOME = 7
#: Pairs a line whose SimHashes and lengths are compared rather than have another round of joins, and the lines of a
#: bucket's largest group that a round compares the others with.
CHEAP, PIVOTS = 50, 16
#: Positions to take out that are sent to all workers at most; more are joined by a shuffle.
BROADCAST_POSITIONS = 2_000_000


def lowered(text: Column) -> Column:
    """The text in lower case, any white space but line ends as a space."""
    other = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in "\t\r\x0b\x0c"))
    return F.lower(F.when(other, F.translate(text, "\t\r\x0b\x0c", "    ")).otherwise(text))


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def once(rows: DataFrame) -> DataFrame:
    """(row, ...) without repeated rows. Only the texts of these are dealt out."""
    twice = small(rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"))
    if twice.isEmpty():
        return rows
    return rows.join(twice, "row", "left_anti").unionByName(rows.join(twice, "row", "left_semi").dropDuplicates(["row"]))


def place_of(word: Column) -> Column:
    """A word's place in an order that has the longest words first, as these are the rarest, and equal lengths by hash."""
    length = F.least(F.length(word), F.lit(63)).cast("long")
    return F.shiftleft(63 - length, 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 7))


def majority_of_five(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    """The SimHash of five features: each bit as most of them have it, by adding bits with carries."""
    one = a.bitwiseXOR(b).bitwiseXOR(c)
    twos = a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseXOR(b)))
    ones = one.bitwiseXOR(d).bitwiseXOR(e)
    more = one.bitwiseAND(d).bitwiseOR(e.bitwiseAND(one.bitwiseXOR(d)))
    return twos.bitwiseAND(more).bitwiseOR(twos.bitwiseXOR(more).bitwiseAND(ones))


def counted(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, g: Column) -> tuple[Column, Column, Column]:
    """How many of seven numbers have a bit, for each bit: the ones, twos and fours of the counts, by adding bits with carries."""

    def add(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        either = x.bitwiseXOR(y)
        return either.bitwiseXOR(z), x.bitwiseAND(y).bitwiseOR(z.bitwiseAND(either))

    (one, u), (other, v) = add(a, b, c), add(d, e, f)
    ones, w = add(one, other, g)
    return ones, *add(u, v, w)


def block_keys(lines: DataFrame) -> DataFrame:
    """(line, words, ...) -> (line, key, ...): a row for each block of a line, with its SimHash, and one for its first word.

    That one alone has the other columns, and no key where no block begins there. Words are rows here, not arrays, so that all of it is compiled code.
    """
    others = [c for c in lines.columns if c not in ("line", "words")]
    each = lines.select("line", *others, "words", F.posexplode("words").alias("i", "word"))
    near = {k: F.get("words", F.col("i") + k) for k in BEYOND}

    def follows(k: int) -> Column:
        other, own = place_of(near[k]), place_of(F.col("word"))
        return near[k].isNull() | (other > own if k < 0 else other >= own)

    around = (F.when(near[k].isNull(), F.lit(v).cast("long")).otherwise(F.xxhash64(near[k])) for k, v in BEYOND.items())
    first = reduce(lambda a, b: a & b, (F.size("words") >= LEAST, *map(follows, (-1, 1, -2, 2))))
    taken = (F.size("words") <= DENSE) | (F.pmod(F.xxhash64(F.lit(0), *(near[k] for k in (-1, 1)), "word"), F.lit(SHARES)) * F.size("words") < DENSE * SHARES)
    key = F.when(first & taken, majority_of_five(F.xxhash64("word"), *around))
    return each.where((F.col("i") == 0) | (first & taken)).select("line", key.alias("key"), *(F.when(F.col("i") == 0, F.col(c)).alias(c) for c in others))


def half_keys(words: Column) -> Column:
    """Keys of a short line's halves, null for others. Of a line and one of a word more, both are cut for the shorter."""

    def half(less: int, back: int) -> Column:
        n = F.size(words) - less
        size = F.floor(n / 2).cast("int")
        part = F.slice(words, F.size(words) - (n - size) + 1, n - size) if back else F.slice(words, F.lit(1), size)
        return F.xxhash64(n, F.lit(back), part)

    return F.when(F.size(words).between(LEAST, SHORT), F.array(*(half(less, back) for less in (0, 1) for back in (0, 1))))


def simhashes(lines: DataFrame) -> DataFrame:
    """(id, ..., words), by all but words -> (id, ..., size, sim): the number of words, and the 64-bit SimHash of the distinct ones.

    Each counts once, as a few words that recur in all prose would make unlike lines alike. Bits of SOME words are first counted where they stand, and these counts added up LANES to a number, in lanes of 32 bits: of a number's lanes the
    counts that reach floor(n / 2) + 1 are those that, with that much less than a flag added, reach the flag.
    """
    width = BITS // LANES
    feet = F.lit(sum(1 << (width * lane) for lane in range(LANES))).cast("long")
    own = [*(c for c in lines.columns if c != "words"), "size"]
    words = lines.withColumn("size", F.size("words")).select(*own, F.array_distinct("words").alias("words")).where("size > 0")
    some = words.select(*own, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(SOME))).alias("i"))
    each = (F.get("words", F.col("i") + k) for k in range(SOME))
    some = some.select(*own, F.least(F.size("words") - F.col("i"), F.lit(SOME)).alias("n"), *(F.when(w.isNotNull(), F.xxhash64(w)).otherwise(0).alias(f"h{k}") for k, w in enumerate(each)))
    some = some.select(*own, "n", *(p.alias(f"p{k}") for k, p in enumerate(counted(*(F.col(f"h{k}") for k in range(SOME))))))

    def of(i: int) -> Column:
        one, two, four = (F.shiftrightunsigned(f"p{k}", i).bitwiseAND(feet) for k in range(3))
        return one + F.shiftleft(two, 1) + F.shiftleft(four, 2)

    sums = some.groupBy(*own).agg(F.sum("n").alias("n"), *(F.sum(of(i)).alias(f"s{i}") for i in range(width)))
    lacking = (F.lit(1 << (width - 2)).cast("long") - 1 - F.shiftright("n", 1)) * feet
    bits = [F.shiftleft(F.shiftrightunsigned(F.col(f"s{i}") + lacking, width - 2).bitwiseAND(feet), i) for i in range(width)]
    return sums.select(*own, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("sim"))


def bit_keys(sims: DataFrame) -> DataFrame:
    """(id, sim, ...) -> (id, key): a row for each choice of PARTS - NEAR blocks of the SimHash's bits. Any two SimHashes within NEAR bits share one."""
    edges = [BITS * i // PARTS for i in range(PARTS + 1)]
    blocks = [F.shiftrightunsigned("sim", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in pairwise(edges)]
    keys = (F.xxhash64(F.lit(i), *(blocks[k] for k in some)) for i, some in enumerate(combinations(range(PARTS), PARTS - NEAR)))
    return sims.select("id", F.explode(F.array(*keys)).alias("key"))


def long_simhashes(lines: DataFrame) -> DataFrame:
    """(line, words, ...) with copies of lines -> (id, size, sim) of those of more words than DENSE, once each.

    Copies leave each bit's majority as it is. They are added up by task, so that no lane overflows however many there are.
    """
    each = lines.where(F.size("words") > DENSE).select(F.col("line").alias("id"), F.spark_partition_id().alias("task"), "words")
    return simhashes(each).select("id", "size", "sim").distinct()


def shared(keyed: DataFrame) -> DataFrame:
    """(key, id), each once, of the keys that two ids or more have. Rows are dealt out by key once, for both sides of the join."""
    dealt = keyed.where("key is not null").select("key", "id").repartition("key")
    full = dealt.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return dealt.join(full.hint("shuffle_hash"), "key").distinct()


def spelled(words: Column, shift: int) -> Column:
    """A text of one character a word, by 20 bits of the word's hash: these are put into a pair of surrogates."""
    bits = lambda w: F.shiftrightunsigned(F.xxhash64(w), shift) if shift else F.xxhash64(w)
    pair = lambda w: F.hex(bits(w).bitwiseAND(F.lit(0x03FF03FF).cast("long")).bitwiseOR(F.lit(0xD800DC00).cast("long")))
    return F.decode(F.unhex(F.array_join(F.transform(words, pair), "")), "UTF-16BE")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less its repeated lines, and n_lines, n_lines_removed (lines with a word).

    Lines count as their words in lower case. Equal lines are one; others link that share a block,
    of words or of bits of their SimHashes, and whose edit similarity is SIMILARITY at least. Of each connected group the line of the
    smallest id, then position, stays, and every other occurrence goes, also within a document.
    Null ids come last. Rows of equal id and text keep the same lines. Lines without a word stay as
    they are; a null text stays null, and lines of any length take part. Columns of docs named
    n_lines or n_lines_removed are replaced; others may have any name.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    source = source.withColumn("row", F.xxhash64("id", "text"))
    lines = source.select("id", "row", F.posexplode(F.split(lowered(F.col("text")), "\n")).alias("pos", "line")).where(F.length(F.btrim("line")) > 0)
    lines = lines.select("id", "row", "pos", words_of(F.col("line")).alias("words"))
    lines = lines.select(F.xxhash64("words").alias("line"), "id", "row", "pos", half_keys(F.col("words")).alias("halves"), "words")
    blocks = cut(block_keys(lines), "line-blocks")
    occurrences = cut(blocks.where("row is not null").select("line", "id", "row", "pos"), "line-occurrences")
    halves = blocks.where("halves is not null").select("line", F.explode("halves"))
    sims = cut(long_simhashes(lines), "line-bits")  # their keys are ten times as wide, and are made where they are read
    spread = blocks.where("key is not null").select("line", "key").union(halves).withColumnRenamed("line", "id").union(bit_keys(sims))
    members = cut(shared(spread), "line-members")
    drop(spark, blocks)

    # the words of each candidate, from its first occurrence
    wanted = small(members.select(F.col("id").alias("line")).distinct())
    first = occurrences.join(wanted, "line", "left_semi").groupBy("line").agg(F.min(F.struct("row", "pos")).alias("at"))
    at = small(first.groupBy("at.row").agg(F.collect_list(F.struct("at.pos", "line")).alias("at")))
    held = once(source.select("row", "text")).join(at, "row").select(F.split(lowered(F.col("text")), "\n").alias("lines"), "at")
    held = held.select("lines", F.explode("at").alias("at"))
    texts = cut(held.select(F.col("at.line").alias("id"), words_of(F.get("lines", F.col("at.pos"))).alias("words")), "line-texts")
    shorter = simhashes(texts.where(F.size("words") <= DENSE))
    attributes = cut(shorter.union(sims.join(wanted.withColumnRenamed("line", "id"), "id", "left_semi")), "line-simhashes")
    facts = texts.select("id", spelled(F.col("words"), 0).alias("one"), spelled(F.col("words"), 32).alias("two"))  # worked out for close pairs
    drop(spark, wanted, at, sims)

    def close() -> Column:
        longest = F.greatest("l_size", "r_size")
        return (F.bit_count(F.col("l_sim").bitwiseXOR(F.col("r_sim"))) <= DISTANCE) & (F.least("l_size", "r_size") >= SIMILARITY * longest)

    def similar() -> Column:
        """Words of unlike hashes may share 20 bits of them, but hardly two such parts in the same place."""
        most = F.expr(f"cast(floor((1 - {SIMILARITY}) * greatest(length(l_one), length(r_one)) + 1e-9) as int)")
        return reduce(lambda a, b: a & b, (F.call_function("levenshtein", f"l_{code}", f"r_{code}", most) >= 0 for code in ("one", "two")))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "close-pairs")
        ids = small(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        some = cut(facts.join(ids, "id", "left_semi"), "line-facts")
        left, right = (some.select(*(F.col(c).alias(f"{p}_{c}") for c in facts.columns)) for p in "lr")
        return pairs.join(left, F.col("a") == F.col("l_id")).join(right, F.col("b") == F.col("r_id")).where(similar()).select("a", "b")

    order = F.struct(F.col("id").isNull().alias("last"), "id", "pos", "row")
    labels = linked(members, verify, attributes, close, carried=True, stars=1, hubs=True, pivots=PIVOTS, most_rounds=3, cheap=CHEAP, most_in_task=0, decided=(facts, similar))
    classes = occurrences.groupBy("line").agg(F.min(order).alias("first"), F.count("*").alias("times"))
    grouped = classes.join(labels.withColumnRenamed("id", "line"), "line", "left").withColumn("label", F.coalesce("label", "line"))
    grouped = cut(grouped.select("line", "label", "first", "times"), "line-groups")
    kept = grouped.groupBy("label").agg(F.min("first").alias("kept"), F.sum("times").alias("times")).where("times > 1")
    of_line = small(grouped.select("line", "label").join(kept, "label").select("line", "kept.row", "kept.pos"))
    gone = occurrences.select("line", F.col("row").alias("at"), F.col("pos").alias("place")).join(of_line, "line").where("at <> row or place <> pos")
    mark, places = fresh("row", docs.columns), fresh("gone", docs.columns)
    gone = cut(gone.groupBy(F.col("at").alias(mark)).agg(F.collect_list("place").alias(places)), "lines-gone")
    drop(spark, occurrences, members, attributes, texts, labels, grouped, of_line)
    few = (gone.select(F.sum(F.size(places))).first()[0] or 0) <= BROADCAST_POSITIONS

    own = [c for c in docs.columns if c not in ("n_lines", "n_lines_removed")]
    out = docs.select(*own, F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col)).alias(mark))
    out = out.join(F.broadcast(gone) if few else gone, mark, "left")
    lines = F.split(text_col, "\n")

    def left(gone: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.transform(F.array(lines), lambda x: F.array_join(F.transform(at, lambda i: F.get(x, i)), "\n"))[0]

    return out.select(
        *(F.when(F.col(places).isNull(), F.col(c)).otherwise(left(F.col(places))).alias(c) if c == text_col else c for c in own),
        # a line with a word is one find: from its first character that is no space to its end
        F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long").alias("n_lines"),
        F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long").alias("n_lines_removed"),
    )
