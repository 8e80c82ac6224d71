"""Interpolated modified Kneser-Ney bigram model: counted over all texts, kept as sorted arrays, mapped by workers.

Words have numbers: their places in the order of their 64-bit hashes. A bigram is the number of its
context above that of its word, in 64 bits, so the bigram arrays of all shards form one sorted
array. Every array is a file in the shared folder; what the driver holds is a list of files.
"""

from __future__ import annotations

import math
import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_file, new_path, put_file, text_or_empty

#: Tokens that a counting task holds before it sends their counts on, and that a scoring task looks up at once.
COUNT_TOKENS, SCORE_TOKENS = 6_000_000, 400_000
CACHE_WORDS = 300_000
#: The end of a text; no word holds white space.
END = b"\n"


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    """Words with A to Z in lower case, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts as byte planes of differences, which compress well."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (steps, counts)]
    return struct.pack("<q", len(keys)) + planes[0] + planes[1]


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<q", data)[0]
    planes = np.frombuffer(data, np.uint8, offset=8).reshape(2, 8, n)
    steps, counts = (np.ascontiguousarray(x.T).reshape(-1).view("<u8") for x in planes)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.uint64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys, counts added."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def dealt(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Rows (shard, data); keys sorted, shard ascending."""
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, int)
    ends = np.append(first[1:], len(shard))
    data = [pack_counts(keys[a:b], counts[a:b]) for a, b in zip(first, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])


def shard_of_hash(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def shard_of_word(w: np.ndarray, words: int, bits: int) -> np.ndarray:
    return ((w << np.uint64(bits)) // np.uint64(words)).astype(np.int32)


def count_words(bits: int):
    """mapInArrow function: (text) -> (shard, data) of word hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size = Hashes(), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return dealt(keys, counts, shard_of_hash(keys, bits))

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                held.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
                size += len(words)
                if size > COUNT_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


@dataclass
class Shard:
    """A file of n sorted keys and their counts; base is the number of the first."""

    path: str
    n: int
    first: int
    base: int = 0


@dataclass
class Model:
    """What scoring needs. Texts differ from it by nothing but the files it names."""

    words: list[Shard]
    bigrams: list[Shard]
    contexts: list[str]
    continuations: list[str]
    bits: int
    end_bits: int  # of the shards of continuations
    n_words: int  # V
    n_tokens: int  # N
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    n_bigrams: int = 0
    word_spread: float = field(default=1.0)  # the share of the uniform distribution in that of single words


class Sorted:
    """Memory-mapped shards that together are one sorted array."""

    def __init__(self, shards: list[Shard]):
        self.firsts = np.array([s.first for s in shards], np.uint64)
        self.bases = [s.base for s in shards]
        self.maps = []
        for s in shards:
            data = map_file(s.path)
            self.maps.append((np.frombuffer(data, "<u8", s.n), np.frombuffer(data, "<u4", s.n, 8 * s.n)))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) of each key; place -1 and count 0 where it isn't there."""
        place, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        cuts = np.append(np.searchsorted(ordered, self.firsts), len(ordered))
        for (own, counts), base, a, b in zip(self.maps, self.bases, cuts[:-1], cuts[1:], strict=True):
            if b > a:
                at = np.minimum(np.searchsorted(own, ordered[a:b]), len(own) - 1)
                same = own[at] == ordered[a:b]
                to, at = order[a:b][same], at[same]
                place[to], count[to] = base + at, counts[at]
        return place, count


class Numbers(dict):
    """word -> (its number << 32) + its count, -1 if it isn't known."""

    def __init__(self, model: Model):
        super().__init__()
        self.sorted = Sorted(model.words)

    def learn(self, words: list[bytes]) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        new = list(set(words).difference(self))
        place, count = self.sorted.find(np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)))
        self.update(zip(new, np.where(place < 0, -1, (place << 32) + np.minimum(count, 2**32 - 1)).tolist(), strict=True))

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each word of texts, joined."""
        words = [w for t in texts for w in t]
        self.learn(words)
        x = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return x >> 32, np.where(x < 0, 0, x & 0xFFFFFFFF)


def contexts_of(number: np.ndarray, sizes: list[int], begin: int) -> np.ndarray:
    """The number before each, begin at the start of each text."""
    out = np.empty_like(number)
    out[1:] = number[:-1]
    out[np.cumsum([0, *sizes[:-1]])] = begin
    return out


def count_bigrams(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        numbers, parts, texts, size, total = Numbers(model), [], [], 0, 0

        def keys() -> np.ndarray:
            number, _ = numbers.of(texts)
            before = contexts_of(number, [len(t) for t in texts], model.n_words)
            return (before.astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64)

        def flush() -> pa.RecordBatch:
            distinct, counts = np.unique(np.concatenate(parts), return_counts=True)
            return dealt(distinct, counts, shard_of_word(distinct >> np.uint64(32), model.n_words + 1, model.bits))

        for batch in batches:
            for text in batch.column(0):
                texts.append(words_of(text.as_py()))
                size += len(texts[-1])
                if size > SCORE_TOKENS:
                    parts.append(keys())
                    total, texts, size = total + size, [], 0
                    if total > COUNT_TOKENS:
                        yield flush()
                        parts, total = [], 0
        if texts:
            parts.append(keys())
        if parts:
            yield flush()

    return run


def grouped(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of a task by shard, counts added."""
    held: dict[int, list] = {}
    for batch in batches:
        for shard, data in zip(batch.column(0), batch.column(1), strict=True):
            held.setdefault(shard.as_py(), []).append(unpack_counts(data.as_py()))
    return {shard: merged(parts) for shard, parts in sorted(held.items())}


def file_of(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return keys.astype("<u8").tobytes() + np.minimum(counts, 2**32 - 1).astype("<u4").tobytes()


def write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (keys, counts) in grouped(batches).items():
            put_file(path := f"{folder}/words-{shard}", file_of(keys, counts))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n": len(keys), "first": str(keys[0]), "total": int(counts.sum())}], schema=WORD_ROWS)

    return run


def count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def write_bigrams(folder: str, words: int, bits: int, end_bits: int):
    """Puts a file of bigrams and one of context figures a shard; a task's continuation counts go on together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = []
        for shard, (keys, counts) in grouped(batches).items():
            put_file(path := f"{folder}/bigrams-{shard}", file_of(keys, counts))
            lo, hi = shard_range(shard, words + 1, bits)
            at = (keys >> np.uint64(32)).astype(np.int64) - lo
            figures = [np.bincount(at, counts, hi - lo), *(np.bincount(at, counts == k, hi - lo) for k in (1, 2)), np.bincount(at, counts >= 3, hi - lo)]
            put_file(f"{folder}/contexts-{shard}", np.stack(figures).astype("<f8").tobytes())
            after.append(np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True))
            row = {"shard": shard, "path": path, "n": len(keys), "first": str(keys[0]), "counts": count_of_counts(counts), "to": -1, "data": b""}
            yield pa.RecordBatch.from_pylist([row], schema=BIGRAM_ROWS)
        if after:
            words_, n = merged(after)
            parts = dealt(words_, n.astype(np.uint64), shard_of_word(words_, words, end_bits)).to_pylist()
            none = {"shard": -1, "path": "", "n": 0, "first": "", "counts": []}
            yield pa.RecordBatch.from_pylist([none | {"to": p["shard"], "data": p["data"]} for p in parts], schema=BIGRAM_ROWS)

    return run


WORD_ROWS = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("first", pa.string()), ("total", pa.int64())])
END_ROWS = pa.schema([("shard", pa.int32()), ("counts", pa.list_(pa.int64())), ("bigger", pa.int64())])
BIGRAM_ROWS = pa.schema(
    [("shard", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("first", pa.string()), ("counts", pa.list_(pa.int64())), ("to", pa.int32()), ("data", pa.binary())]
)


def shard_range(shard: int, words: int, bits: int) -> tuple[int, int]:
    """The numbers of a shard: those n with n * 2**bits // words == shard."""
    return -(-shard * words >> bits), -(-(shard + 1) * words >> bits)


def write_continuations(folder: str, words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (keys, counts) in grouped(batches).items():
            lo, hi = shard_range(shard, words, bits)
            put_file(f"{folder}/continuations-{shard}", np.bincount(keys.astype(np.int64) - lo, counts, hi - lo).astype("<u4").tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": shard, "counts": count_of_counts(counts), "bigger": int((counts >= 3).sum())}], schema=END_ROWS)

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts 1 to 4; 0.5, 1 and 1.5 where these don't give any."""
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return found if all(0 < d < k for k, d in enumerate(found, 1)) else (0.5, 1.0, 1.5)


def train(docs: DataFrame, rows: Column | None = None, text_col: str = "text") -> Model:
    """Count all texts of docs that meet rows. A null text is empty, and counts as its end.

    Two passes read the texts: one numbers the words, one counts bigrams. Counts are added up
    within each task, then dealt to shards by ranges of hashes or of numbers.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    end_bits = math.ceil(math.log2(parts + 1))
    bits = end_bits + 1
    folder = new_path(spark, "language-model")
    texts = (docs if rows is None else docs.where(rows)).select(text_or_empty(text_col).alias("text"))

    def to_shards(df: DataFrame, key: str = "shard") -> DataFrame:
        return df.repartition(parts, key)

    found = to_shards(texts.mapInArrow(count_words(bits), "shard int, data binary"))
    schema = "shard int, path string, n long, first string, total long"
    files = sorted(found.mapInArrow(write_words(folder), schema).collect())
    words, base = [], 0
    for r in files:
        words.append(Shard(r["path"], r["n"], int(r["first"]), base))
        base += r["n"]
    model = Model(words, [], [], [], bits, end_bits, base, sum(r["total"] for r in files))
    if not base:
        return model
    spread = to_shards(texts.mapInArrow(count_bigrams(spark.sparkContext.broadcast(cloudpickle.dumps(model))), "shard int, data binary"))
    schema = "shard int, path string, n long, first string, counts array<long>, to int, data binary"
    written = new_path(spark, "bigram-shards")
    spread.mapInArrow(write_bigrams(folder, base, bits, end_bits), schema).write.parquet(written)
    written = spark.read.schema(schema).parquet(written)
    files = sorted(written.where("to = -1").select("shard", "path", "n", "first", "counts").collect())
    after = to_shards(written.where("to >= 0").select(F.col("to").alias("shard"), "data"))
    ends = sorted(after.mapInArrow(write_continuations(folder, base, end_bits), "shard int, counts array<long>, bigger long").collect())
    model.bigrams = [Shard(r["path"], r["n"], int(r["first"])) for r in files]
    model.contexts = [f"{folder}/contexts-{r['shard']}" if r else "" for r in by_shard(files, bits)]
    model.continuations = [f"{folder}/continuations-{r['shard']}" if r else "" for r in by_shard(ends, end_bits)]
    model.n_bigrams = sum(r["n"] for r in files)
    model.discounts = discounts([sum(r["counts"][k] for r in files) for k in range(4)])
    n = [sum(r["counts"][k] for r in ends) for k in range(4)]
    model.word_discounts = discounts(n)
    kinds = (n[0], n[1], sum(r["bigger"] for r in ends))
    model.word_spread = sum(d * k for d, k in zip(model.word_discounts, kinds, strict=True)) / model.n_bigrams
    return model


def by_shard(rows: list, bits: int) -> list:
    found = {r["shard"]: r for r in rows}
    return [found.get(i) for i in range(1 << bits)]


class Dense:
    """Memory-mapped figures of numbered words, shard by shard."""

    def __init__(self, paths: list[str], words: int, bits: int, kind: str, rows: int):
        self.words, self.bits, self.rows = words, bits, rows
        self.maps = [np.frombuffer(map_file(p), kind).reshape(rows, -1) if p else None for p in paths]
        self.lows = [shard_range(i, words, bits)[0] for i in range(len(paths))]

    def of(self, number: np.ndarray) -> np.ndarray:
        """Figures of each number, 0 for -1."""
        out = np.zeros((self.rows, len(number)))
        shard = np.where(number < 0, -1, shard_of_word(np.maximum(number, 0).astype(np.uint64), self.words, self.bits))
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(self.maps) + 1))
        for own, low, a, b in zip(self.maps, self.lows, cuts[:-1], cuts[1:], strict=True):
            if b > a and own is not None:
                to = order[a:b]
                out[:, to] = own[:, number[to] - low]
        return out


class Reader:
    """A model with its files mapped."""

    def __init__(self, model: Model):
        self.model, self.numbers, self.bigrams = model, Numbers(model), Sorted(model.bigrams)
        self.contexts = Dense(model.contexts, model.n_words + 1, model.bits, "<f8", 4)
        self.after = Dense(model.continuations, model.n_words, model.end_bits, "<u4", 1)

    def score(self, texts: list[list[bytes]]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base log10, model log10) of each text."""
        m = self.model
        sizes = [len(t) for t in texts]
        number, count = self.numbers.of(texts)
        base = np.log10((count + 1) / (m.n_tokens + m.n_words + 1))
        kinds, inverse = np.unique(number, return_inverse=True)
        ends = self.after.of(kinds)[0]
        off = np.array([0.0, *m.word_discounts])[np.minimum(ends, 3).astype(int)]
        single = ((ends - off) / max(1, m.n_bigrams) + m.word_spread / (m.n_words + 1))[inverse]
        before = contexts_of(number, sizes, m.n_words)
        kinds, inverse = np.unique(before, return_inverse=True)
        total, *n = self.contexts.of(kinds)
        spread = np.where(total > 0, sum(d * k for d, k in zip(m.discounts, n, strict=True)) / np.maximum(total, 1), 1.0)
        total, spread = np.maximum(total, 1)[inverse], spread[inverse]
        key = (before.astype(np.uint64) << np.uint64(32)) + np.maximum(number, 0).astype(np.uint64)
        seen = np.where((before >= 0) & (number >= 0), self.bigrams.find(key)[1], 0)
        pair = (seen - np.array([0.0, *m.discounts])[np.minimum(seen, 3)]) / total
        logs = np.log10(pair + spread * single)
        first = np.cumsum([0, *sizes[:-1]])
        known = np.add.reduceat((count > 0).astype(np.int64), first)
        return list(zip(sizes, known.tolist(), np.add.reduceat(base, first).tolist(), np.add.reduceat(logs, first).tolist(), strict=True))


def scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(pickle.loads(held.value))
        names = ["id", "n_tokens", "n_known", "base_score", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

        def emit(ids: list, texts: list) -> pa.RecordBatch:
            columns = zip(*((i, *x) for i, x in zip(ids, reader.score(texts), strict=True)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                texts.append(words_of(text.as_py()))
                size += len(texts[-1])
                if size > SCORE_TOKENS:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield emit(ids, texts)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, n_tokens, n_known, train_tokens, base_score, score, perplexity).

    Tokens are the words of the whole text and its end; a null text is empty. score is the
    model's log10 probability, base_score that of single words with one added to each count, both
    of which give words that the training texts lack a share. Null ids stay null; repeated rows
    give repeated results. Other columns are ignored. Without training texts every probability is 1.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    out = source.mapInArrow(scorer(held), "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
