"""Token counts with a cache of digests: content and tokenizer digests are joined to stored counts, and only texts that no
earlier run has counted are encoded, each once, and appended.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, exists, small, text_or_empty, worker_state

LIMIT = 4096
#: Words whose counts a worker keeps.
CACHE_WORDS = 1_000_000
STORED = "content binary, n_tokens long"
#: What stands for a space in sentencepiece's pieces.
SPACE = "▁"


class Pieces:
    """Counts by sentencepiece.

    Where no piece of the vocabulary has a space after another character, no merge crosses the place before a run of spaces
    that follows a word. The run and the word after it are then encoded by themselves, once for each worker; their counts add up to the text's.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model, self.seen = SentencePieceProcessor(model_file=path), {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # the model puts a space before the text, and leaves all others as they are
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) and self.model.encode("a  b ", out_type=str)[0] == f"{SPACE}a" and self.model.normalize(" a  b ") == SPACE * 2 + f"a{SPACE * 2}b{SPACE}"

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def __call__(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if not self.apart or SPACE in text:  # the model takes that character for a space
                out += self.counts([text])
                continue
            words = text.split(" ")
            if "" in words:  # all spaces before a word but one
                words = [w[1:] for w in re.findall(" +[^ ]*", " " + text)] if text else []
            if len(self.seen) > CACHE_WORDS:
                self.seen.clear()
            if new := list(set(words).difference(self.seen)):
                self.seen.update(zip(new, self.counts([w or SPACE for w in new]), strict=True))
            out.append(sum(map(self.seen.__getitem__, words)))
        return out


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """The counts of texts by the library that reads the file: tokenizers for .json, sentencepiece for .model. Nothing is added, cut or padded."""
    if path.endswith(".model"):
        return Pieces(path)
    if not path.endswith(".json"):
        raise ValueError(f"no library for {path}")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_version(path: str) -> str:
    """The digest of all that decides a tokenizer's counts: its file, and the library and its version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library} {__import__(library).__version__}\n".encode() + file.read()).hexdigest()


def encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_state(f"counter {path}", lambda: counter(path))
        for batch in batches:
            numbers: list[int] = []
            for text in batch.column("text"):  # one text at a time, however long
                numbers += count([text.as_py()])
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(numbers, pa.int64())], ["content", "n_tokens"])

    return run


def stored_counts(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) of a tokenizer, one row a text; two runs that appended the same text agree."""
    spark, path = docs.sparkSession, f"{cache}/tokenizer={version}"
    if not exists(spark, path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(path).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit), one row for each of docs, by the tokenizer at path, a file on all machines.

    cache is a folder that the workers share; it is made at first use and grows by the texts that it lacks. A run that is
    ended leaves it as it was or with right rows. normalise is a text expression that leaves the tokenizer's counts as they
    are: texts that it makes equal are counted once; without it texts are taken as they are. n_bytes is that of the whole text.

    A null text counts as empty, with no tokens; repeated rows each have a row, of null ids too; whole texts of any length
    are encoded. Other columns of docs aren't looked at, and may have any name; an empty table gives an empty one.
    """
    version = tokenizer_version(path)
    text = normalise(text_or_empty(text_col)) if normalise else text_or_empty(text_col)
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"))
    content = F.unhex(F.sha2(F.col("text"), 256)).alias("content")
    keys = cut(docs.select("id", "n_bytes", content), "token-keys")

    # of the rows of an unknown content those of its least id stand for it; no text is moved but those of repeated rows
    rows = keys.groupBy("content", "id").agg(F.count("*").alias("times"))
    first = rows.groupBy("content").agg(F.min(F.struct("id", "times")).alias("at")).join(stored_counts(docs, cache, version), "content", "left_anti")
    first = cut(first.select("content", F.struct("at.id", "at.times").alias("at")), "token-misses")
    marked = rows.join(first, "content", "left").select("content", "id", "times", (F.col("at").isNotNull() & F.col("id").eqNullSafe(F.col("at.id"))).alias("first"))
    marked = cut(marked, "token-rows")
    whole = docs.select("id", "text", content)
    once, repeated = (marked.where("first").where(c).select(F.col("content").alias("content_"), F.col("id").alias("id_")) for c in ("times = 1", "times > 1"))
    others = marked.where("not first or times > 1").select(F.col("content").alias("content_"), F.col("id").alias("id_"))
    same = F.col("content").eqNullSafe(F.col("content_")) & F.col("id").eqNullSafe(F.col("id_"))
    wanted = whole.join(small(others), same, "left_anti") if others.count() <= once.count() else whole.join(small(once), same, "left_semi")
    wanted = wanted.select("content", "text")
    if not repeated.isEmpty():
        wanted = wanted.unionByName(whole.join(small(repeated), same, "left_semi").select("content", "text").dropDuplicates(["content"]))
    if not first.isEmpty():
        wanted.mapInArrow(encoded(path), STORED).write.mode("append").parquet(f"{cache}/tokenizer={version}")
    counts = stored_counts(docs, cache, version).join(marked.select("content").distinct(), "content", "left_semi")
    counts = cut(counts, "token-counts")  # joined without an aggregate below, so that Spark can split the rows of a hot content
    drop(docs.sparkSession, first, marked)

    out = keys.join(counts, "content", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
