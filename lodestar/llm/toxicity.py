"""Toxicity by multiple-instance learning: documents have labels, their sentences have the scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: The bounded sample of labelled rows that the classifier is fitted on: documents of each label, by a hash of the id.
MOST_TOXIC, MOST_CLEAN = 3_000, 6_000
BUCKETS = 1 << 18
#: A word's features are itself and its beginnings of these many characters. Those of fewer documents of the sample, or
#: that stand in toxic and clean ones alike (by a z score of their shares), have no weight.
PREFIXES = (4, 5, 6)
LEAST_DOCS, LEAST_Z = 5, 5.0
STEPS, RATE, SHRINK = 300, 0.1, 2e-6
THRESHOLD = 0.7
CACHE_WORDS = 300_000
END = 1024.0
EDGES = bytes(c for c in range(128) if not chr(c).isalnum())
SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?](?![\x20\x09-\x0D]|\Z)[^\n.!?]*)*[.!?]*")


def buckets(word: bytes) -> list[int]:
    """Of the features of a lower-case word without the punctuation around it; none if nothing is left."""
    core = word.strip(EDGES).decode("utf-8", "replace")
    parts = {f"={core}", *(f"{n}{core[:n]}" for n in PREFIXES if len(core) >= n)} if core else ()
    return sorted({xxhash.xxh3_64_intdigest(x) % BUCKETS for x in parts})


def tokens(text: str) -> list[bytes]:
    """Words, a line's end as a word that ends a sentence."""
    return text.lower().encode("utf-8", "replace").replace(b"\n", b" . ").split()


def ends(word: bytes) -> bool:
    return word[-1:] in b".!?"


class Instances(dict):
    """word -> its number, below 0 (~number) where it ends a sentence; features has the buckets by number."""

    def __init__(self):
        super().__init__()
        self.features: list[list[int]] = []

    def __missing__(self, word: bytes) -> int:
        n = len(self.features)
        self.features.append(buckets(word))
        value = self[word] = ~n if ends(word) else n
        return value


def telling(df: np.ndarray, toxic_df: np.ndarray, docs: int, toxic: int) -> np.ndarray:
    """Features of enough documents whose share differs between toxic and clean documents."""
    share = df / docs
    gap = toxic_df / toxic - (df - toxic_df) / (docs - toxic)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / toxic + 1 / (docs - toxic)))
    return (df >= LEAST_DOCS) & (np.abs(gap) >= LEAST_Z * spread)


def fit(bags: list[tuple[int, np.ndarray]], features: list[list[int]]) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias that maximise the noisy-or likelihood of the labels.

    bags: (label, coded words). A document is toxic unless all of its sentences are clean:
    1 - P = product of 1 - p over its sentences, p the logistic of a sentence's summed weights.
    """
    weights = np.zeros(BUCKETS)
    bags = [(y, x) for y, x in bags if len(x)]
    labels = np.array([y for y, _ in bags], bool)
    if not labels.any() or labels.all():
        return weights, (40.0 if len(bags) and labels.all() else -40.0)
    counts = np.array([len(x) for x in features])
    flat = np.fromiter((y for x in features for y in x), np.int64, counts.sum())
    first = np.concatenate([[0], np.cumsum(counts)])
    df, toxic_df = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for y, x in bags:
        own = np.unique(np.where(x < 0, ~x, x))
        own = np.unique(np.concatenate([flat[first[i] : first[i + 1]] for i in own.tolist()]))
        df[own] += 1
        toxic_df[own] += y
    chosen = telling(df, toxic_df, len(bags), int(labels.sum()))
    # word by feature, of the chosen features only
    keep = chosen[flat]
    of_word = np.repeat(np.arange(len(features)), counts)[keep]
    names, of_feature = np.unique(flat[keep], return_inverse=True)
    has = np.zeros(len(features), bool)
    has[of_word] = True
    sizes = [len(x) for _, x in bags]
    coded = np.concatenate([x for _, x in bags])
    last = coded < 0
    last[np.cumsum(sizes) - 1] = True
    word = np.where(coded < 0, ~coded, coded)
    sentence = np.cumsum(last) - last
    doc_of_sentence = np.repeat(np.arange(len(bags)), sizes)[last]
    used = has[word]
    word, sentence, n = word[used], sentence[used], len(doc_of_sentence)
    toxic_sentence = labels[doc_of_sentence]
    w, bias = np.zeros(len(names)), -5.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        of = np.bincount(of_word, w[of_feature], len(features))
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence, of[word], n), -30, 30)))
        clean = np.exp(np.bincount(doc_of_sentence, np.log1p(-p), len(bags)))
        ratio = clean / np.maximum(1 - clean, 1e-9)
        slope = np.where(toxic_sentence, -p * ratio[doc_of_sentence], p) / len(bags)
        up = np.bincount(word, slope[sentence], len(features))
        grad = np.append(np.bincount(of_feature, up[of_word], len(names)) + SHRINK * w, slope.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        w -= move[:-1]
        bias -= move[-1]
    weights[names] = w
    return weights, float(bias)


def fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, bags = Instances(), []
    for batch in batches:
        for y, text in zip(batch.column(0), batch.column(1), strict=True):
            words = tokens(text.as_py())
            bags.append((y.as_py(), np.fromiter(map(cache.__getitem__, words), np.int32, len(words))))
    weights, bias = fit(bags, cache.features)
    yield pa.RecordBatch.from_arrays([pa.array([packed(weights, bias)], pa.binary())], ["model"])


def packed(weights: np.ndarray, bias: float) -> bytes:
    return np.append(weights, bias).astype("<f4").tobytes()


def train(
    docs: DataFrame, labels: DataFrame, rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN,
) -> bytes:
    """The model, of a fixed size, from the labelled rows of docs whose id meets rows.

    At most most_toxic and most_clean documents are used, those of the smallest hash of the id, so
    the fit is one task over a bounded sample. Rows without a label, id or text are left out;
    repeated labels of an id count once, 1 if any is 1. Of several texts of one id that of the least
    hash is taken, and rows are fitted in the order of their ids, so the same rows give the same model.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("id is not null and y is not null").groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    if rows is not None:
        known = known.where(rows)
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = source.join(F.broadcast(parts[0].union(parts[1])), "id")
    sample = sample.groupBy("id").agg(F.max("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    row = sample.coalesce(1).sortWithinPartitions("id").select("y", "text").mapInArrow(fit_batches, "model binary").first()
    return bytes(row["model"]) if row else packed(*fit([], []))


class Weights(dict):
    """word -> its weight, END more where it ends a sentence."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = float(self.weights[buckets(word)].sum()) + (END if ends(word) else 0.0)
        return value


def sentence_scores(words: list[bytes], weights: Weights, bias: float) -> np.ndarray:
    x = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    last = x > END / 2
    x -= END * last
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    return 1 / (1 + np.exp(-np.clip(bias + np.add.reduceat(x, starts), -30, 30)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans of sentences with a word, in code points: they end at a line's end or at a word's last . ! or ?"""
    out = []
    for m in SENTENCE.finditer(text):
        part = m[0]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((m.start() + lead, m.start() + lead + len(part.strip())))
    return out


def scorer(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(model.value, "<f4").astype(np.float64)
        weights, bias = Weights(data[:-1]), float(data[-1])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1):
                text = text.as_py()
                words = tokens(text)
                scores.append(noisy_or(sentence_scores(words, weights, bias)) if text.strip() else 0.0)
                spans = []
                for a, b in sentence_spans(text) if scores[-1] >= threshold else ():
                    p = noisy_or(sentence_scores(tokens(text[a:b]), weights, bias))
                    if p >= 0.5:
                        spans.append({"start": a, "end": b, "score": p})
                found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], ["id", "score", "sentences"])

    return run


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: (id, score, predicted, sentences).

    score is the noisy-or of the sentences' scores, 0 for a null or empty text. predicted is 1 from
    the threshold on; then sentences lists (start, end, score), in code points, of those that are
    more likely toxic than not. Null ids stay null; repeated rows give repeated results. Other
    columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = source.mapInArrow(scorer(held, threshold), "id long, score double, sentences array<struct<start long, end long, score double>>")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")
