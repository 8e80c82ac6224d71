"""Near-duplicate documents: MinHash bands propose pairs, odd sketches screen them, full sets confirm."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import linked
from .shared import cut, small, text_or_empty

#: MinHash samples of a set; all of them enter its odd sketch of SKETCH_WORDS * 64 bits.
SAMPLES, SKETCH_WORDS = 128, 8
#: The same for sets of which a first round left links open, whose pairs must be told apart near the threshold.
FINE_SAMPLES, FINE_WORDS = 2048, 128
#: Words of text held at once by a worker, and entries of its word cache.
CHUNK_WORDS = 400_000
CACHE_WORDS = 300_000
MISS = 1e-6
#: Rows of a class from which its component is sent to where they are; there is one such class in so many rows at most.
MANY = 1_000


def banding(threshold: float, samples: int = SAMPLES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the longest rows whose chance to miss a pair at the threshold is under miss."""
    for rows in range(12, 1, -1):
        bands = samples // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    return samples, 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence where it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def set_key(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """MinHash values, one column a set."""
    rng = np.random.default_rng(20240229)
    mult = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, samples, dtype=np.uint64)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x = np.concatenate(sets)
    return np.stack([np.minimum.reduceat(x * m + a, starts) for m, a in zip(mult, add, strict=True)])


def odd_sketch(sig: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity bitmap of each column's samples, in 64-bit words."""
    out = np.zeros((sig.shape[1], words), np.uint64)
    cols = np.arange(sig.shape[1])
    for i, row in enumerate(sig):
        pos = mix(row + np.uint64((i + 1) * 0xD1342543DE82EF95 % 2**64)) % np.uint64(words * 64)
        out[cols, (pos >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (pos & np.uint64(63))
    return out


def features(width: int, bands: int, rows: int):
    """mapInArrow function: (id, text, text_key) -> (id, n_shingles, cls, bands, sketch, text_key). Empty sets have a null cls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()

        def emit(ids: list, sets: list[np.ndarray], texts: list) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            keys, sketch, cls = [], [], []
            if full:
                sig = signatures(full, SAMPLES)
                cols = []
                for b in range(bands):
                    h = np.full(sig.shape[1], b + 1, np.uint64)
                    for r in range(rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[b * rows + r])
                    cols.append(h)
                keys, sketch = iter(np.stack(cols, 1).view(np.int64)), iter(odd_sketch(sig).view(np.int64))
                cls = map(set_key, full)
            cls = iter(cls)
            have = [len(s) > 0 for s in sets]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(cls) if x else None for x in have], pa.int64()),
                    pa.array([next(keys) if x else None for x in have], pa.list_(pa.int64())),
                    pa.array([next(sketch) if x else None for x in have], pa.list_(pa.int64())),
                    pa.array(texts, pa.int64()),
                ],
                ["id", "n_shingles", "cls", "bands", "sketch", "text_key"],
            )

        for batch in batches:
            ids, sets, texts, held = [], [], [], 0
            for i, text, key in zip(*batch.columns, strict=True):
                s = shingles(text.as_py() or "", width, cache)
                ids.append(i.as_py())
                sets.append(s)
                texts.append(key.as_py())
                held += len(s)
                if held > CHUNK_WORDS:
                    yield emit(ids, sets, texts)
                    ids, sets, texts, held = [], [], [], 0
            if ids:
                yield emit(ids, sets, texts)

    return run


def confirm(width: int, num: int, den: int):
    """mapInArrow function over (a, b, a_text, b_text): pairs whose full sets meet the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out_a, out_b = [], []
            for row in range(batch.num_rows):
                a, b = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                one = shingles(batch.column(2)[row].as_py() or "", width, cache)
                two = shingles(batch.column(3)[row].as_py() or "", width, cache)
                if set_key(one) != a or set_key(two) != b:  # another row that shares the id
                    continue
                both = np.intersect1d(one, two, assume_unique=True).size
                if den * both >= num * (len(one) + len(two) - both):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def exploded(width: int):
    """mapInArrow function over (id, label, text): a row (g, id, label) for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for i, label, text in zip(*batch.columns, strict=True):
                s = shingles(text.as_py() or "", width, cache)
                if set_key(s) == i.as_py():
                    columns = [s.view(np.int64), np.full(len(s), i.as_py()), np.full(len(s), label.as_py())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["g", "id", "label"])

    return run


def fine_sketches(width: int):
    """mapInArrow function over (id, label, text): (id, fine), the sketch of FINE_SAMPLES samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()

        def emit(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            sketches = list(odd_sketch(signatures(sets, FINE_SAMPLES), FINE_WORDS).view(np.int64)) if ids else []
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], ["id", "fine"])

        for batch in batches:
            ids, sets, held = [], [], 0
            for i, text in zip(batch.column(0), batch.column(2), strict=True):
                s = shingles(text.as_py() or "", width, cache)
                if set_key(s) == i.as_py():
                    ids.append(i.as_py())
                    sets.append(s)
                    held += len(s) + FINE_SAMPLES
                if held > CHUNK_WORDS:
                    yield emit(ids, sets)
                    ids, sets, held = [], [], 0
            yield emit(ids, sets)

    return run


def most_differing(threshold: float, samples: int = SAMPLES, words: int = SKETCH_WORDS) -> int:
    """The XOR population count that a pair at the threshold exceeds with a chance of about 1e-7.

    Samples that differ are binomial; each toggles two bits, and toggles that meet cancel.
    """
    bits, differ = words * 64, samples * (1 - threshold)
    left = (1 - 2 / bits) ** (2 * differ)
    spread = math.sqrt((2 * left) ** 2 * samples * threshold * (1 - threshold) + 8 * differ * differ / bits)
    return math.ceil(bits / 2 * (1 - left) + 5.2 * spread)


def sketch_differs(left: str, right: str) -> Column:
    return sum((F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(SKETCH_WORDS)), F.lit(0))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """One row per row of docs: (id, n_shingles, component_id, kept, text_key), the last the xxhash64 of the text.

    Documents are linked where den * |A & B| >= num * |A | B| for their sets of word shingles.
    component_id is the smallest id reachable over links, the row's own id included; kept marks
    that row. Documents with equal sets form one class and are compared once. A null or empty
    text has no shingles and no link; a null id stays null and kept. Repeated rows give repeated
    results. Other columns are ignored.
    """
    threshold = num / den
    bands, rows = banding(threshold)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    feats = cut(
        source.withColumn("text_key", F.xxhash64("text")).mapInArrow(
            features(width, bands, rows), "id long, n_shingles long, cls long, bands array<long>, sketch array<long>, text_key long"
        ),
        "shingle-features",
    )
    classes = cut(
        feats.where("cls is not null and id is not null")
        .groupBy("cls")
        .agg(F.min("id").alias("doc"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "shingle-classes",
    )
    spread = classes.select(F.explode("bands").alias("key"), F.col("cls").alias("id"))
    full = spread.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    members = cut(spread.join(full, "key").distinct(), "band-members")
    attributes = classes.select(F.col("cls").alias("id"), "n", "sketch", "doc")
    # the texts that verification may ask for, read and dealt out once
    wanted = members.select("id").distinct().join(attributes, "id").select("doc").distinct()
    texts = cut(source.withColumnRenamed("id", "doc").join(small(wanted), "doc", "left_semi"), "candidate-texts")

    def enough(both: Column, left: Column, right: Column) -> Column:
        return den * both >= num * (left + right - both)

    def close() -> Column:
        sizes = enough(F.least("l_n", "r_n"), F.col("l_n"), F.col("r_n"))
        return sizes & (sketch_differs("l_sketch", "r_sketch") <= most_differing(threshold))

    def closer() -> Column:
        """By the facts of screen; a pair that meets in several buckets counts in one of them."""
        sizes = enough(F.least("l_n", "r_n", "l_shared", "r_shared"), F.col("l_n"), F.col("r_n"))
        coarse = sketch_differs("l_sketch", "r_sketch") <= most_differing(threshold)
        bits = F.zip_with("l_fine", "r_fine", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        fine = F.aggregate(bits, F.lit(0), lambda a, x: a + x) <= most_differing(threshold, FINE_SAMPLES, FINE_WORDS)
        return sizes & coarse & fine & (F.array_min(F.array_intersect("l_bands", "r_bands")) == F.col("l_key"))

    def alive() -> Column:
        return enough(F.col("shared"), F.col("n"), F.greatest("n_lo", F.floor(F.col("n") * num / den)))

    def verify(pairs: DataFrame) -> DataFrame:
        sides = [attributes.select(*(F.col(c).alias(f"{p}_{c}") for c in attributes.columns)) for p in "lr"]
        likely = pairs.join(sides[0], F.col("a") == F.col("l_id")).join(sides[1], F.col("b") == F.col("r_id")).where(close())
        one, two = (texts.select(F.col("doc").alias(f"{p}_doc"), F.col("text").alias(f"{p}_text")) for p in "lr")
        both = likely.select("a", "b", "l_doc", "r_doc").join(one, "l_doc").join(two, "r_doc")
        return both.select("a", "b", "l_text", "r_text").mapInArrow(confirm(width, num, den), "a long, b long").distinct()

    def screen(nodes: DataFrame) -> DataFrame:
        """shared: how many shingles of a set occur under other labels too. A link to one of these has no more in common."""
        plain = classes.select(F.col("cls").alias("id"), "n", "bands", "sketch", "doc")
        known = nodes.join(plain.select("id", "doc"), "id").join(texts, "doc").select("id", "label", "text")
        grams = cut(known.mapInArrow(exploded(width), "g long, id long, label long"), "shingles")
        several = grams.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("g")
        own = grams.select("g", "id").join(several, "g").distinct().groupBy("id").agg(F.count("*").alias("shared"))
        fine = known.mapInArrow(fine_sketches(width), "id long, fine array<long>")
        return fine.join(plain.drop("doc"), "id").join(own, "id", "left").fillna(0, ["shared"])

    labels = linked(members, verify, attributes, closer, screen, alive)
    of_class = classes.select("cls", "doc", "copies").join(labels.withColumnRenamed("id", "cls"), "cls", "left")
    of_class = of_class.withColumn("label", F.coalesce("label", "cls"))
    least = of_class.groupBy("label").agg(F.min("doc").alias("least"))
    of_class = cut(of_class.join(least, "label").select("cls", "copies", "least"), "class-components")
    # rows without a class stay where they are, and those of classes of many copies meet their component there
    rows, many = feats.select("id", "n_shingles", "cls", "text_key"), small(of_class.where(F.col("copies") >= MANY).select("cls", "least"))
    few = rows.where("cls is not null").join(many, "cls", "left_anti").join(of_class.where(F.col("copies") < MANY).select("cls", "least"), "cls", "left")
    out = few.unionByName(rows.join(many, "cls")).unionByName(rows.where("cls is null").withColumn("least", F.lit(None).cast("long")))
    component = F.coalesce("least", "id")
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        "text_key",
    )
