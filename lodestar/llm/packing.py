"""Sequence packing: whole windows first, then remainders by minimum bin slack."""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty, worker_state

CAPACITY = 4096
#: Remainders packed together; more than these are not held by a worker.
WINDOW = 16_384
CACHE_WORDS = 1_200_000
#: Words encoded as one text.
LINE_WORDS = 500
BATCH_WORDS = 200_000


class WordIds(dict):
    """Little-endian 32-bit ids of a word, of a tokenizer none of whose tokens crosses white space.

    Words of letters alone are one pre-token, whose last id, and no other, ends a word. They are
    encoded as one text and told apart by that; all other words are encoded one by one.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

    def encode(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode_letters(self, words: list[str]) -> list[bytes]:
        lines = [" ".join(words[i : i + LINE_WORDS]) for i in range(0, len(words), LINE_WORDS)]
        ids = np.frombuffer(b"".join(self.encode(lines)), "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self.encode(words)
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[i:j] for i, j in pairwise(at)]

    def learn(self, words: list[bytes]) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        odd, split, letters = [], [], {}
        for w in set(words).difference(self):
            core = w.rstrip(b".,")
            text = core.decode("utf-8", "replace")
            low = text.lower()
            if low.isalpha():
                text = low if text.isascii() else text
                if text not in letters and text.encode() not in self:
                    letters[text] = b""
                split.append((w, text, w[len(core) :].decode()))
            else:
                odd.append(w)
        if letters:
            letters = dict(zip(letters, self.encode_letters(list(letters)), strict=True))
            self.update((text.encode(), ids) for text, ids in letters.items())
        tails = {t: b"" for _, _, t in split}
        tails = dict(zip(tails, self.encode(list(tails)), strict=True))
        for w, text, tail in split:
            self[w] = self[text.encode()] + tails[tail]
        self.update(zip(odd, self.encode([w.decode("utf-8", "replace") for w in odd]), strict=True))


def words_of(text: str) -> list[bytes]:
    """Words at white space. The tokenizer ignores case, but in the names of special tokens."""
    data = text.encode("utf-8", "replace")
    return (data if b"<|" in data else data.lower()).split()


def fill(pool: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset of lengths from pool (length -> count) whose sum is closest to capacity from below.

    lengths: those of pool, ascending. The longest length takes part. The rest is a bounded subset sum over a bitset of reachable
    sums, one step for each length and binary part of its count; it ends where the capacity is
    reached. The steps kept are walked back for the counts.
    """
    longest = lengths[-1]
    room = capacity - longest
    taken = defaultdict(int, {longest: 1})
    mask, reach = (1 << (room + 1)) - 1, 1
    steps = []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        count = min(pool[length] - (length == longest), room // length)
        part = 1
        while count > 0 and not reach >> room & 1:
            part = min(part, count)
            steps.append((reach, length, part))
            reach |= reach << (length * part) & mask
            count -= part
            part *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            taken[length] += part
            at -= length * part
    return taken


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in lengths; each bin's lengths sum to the capacity or less."""
    where = defaultdict(list)
    for i, n in enumerate(lengths):
        where[n].append(i)
    pool = {n: len(x) for n, x in where.items()}
    left = sorted(pool)
    bins = []
    while pool:
        bin_ = []
        for n, count in fill(pool, left, capacity).items():
            bin_ += [where[n].pop() for _ in range(count)]
            pool[n] -= count
            if not pool[n]:
                del pool[n], left[bisect_left(left, n)]
        bins.append(bin_)
    return bins


SCHEMA = pa.schema(
    [
        ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
    ]
)


def packer(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state(f"word ids of {path}", lambda: WordIds(path))
        end = np.asarray([end_id], "<u4").tobytes()
        base, made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, 0
        rest: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(SCHEMA)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, rest
            rows = []
            for bin_ in pack_lengths([x[2] for x in rest], capacity):
                offset = 0
                for i in bin_:
                    piece = rest[i]
                    rows.append((*piece[:5], base + made, offset, piece[5]))
                    offset += piece[2]
                made += 1
            rest = []
            if rows:
                yield emit(rows)

        for batch in batches:
            rows = []
            for lo, hi in chunks(batch.column(1)):
                split = [words_of(x.as_py() or "") for x in batch.column(1)[lo:hi]]
                cache.learn([w for words in split for w in words])
                for i, words in zip(batch.column(0)[lo:hi], split, strict=True):
                    data = b"".join(map(cache.__getitem__, words)) + end
                    n = len(data) // 4
                    for start in range(0, n, capacity):
                        part = data[4 * start : 4 * (start + capacity)]
                        piece = (i.as_py(), start, len(part) // 4, zlib.crc32(part), n, part if with_ids else None)
                        if piece[2] == capacity:
                            rows.append((*piece[:5], base + made, 0, piece[5]))
                            made += 1
                        else:
                            rest.append(piece)
                            if len(rest) >= WINDOW:
                                yield from flush()
            if rows:
                yield emit(rows)
        yield from flush()

    return run


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of texts of some BATCH_WORDS words, a text at least."""
    lo = held = 0
    for i, text in enumerate(texts):
        held += len(text.as_py() or "") // 6
        if held > BATCH_WORDS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those of its text and end_id. It is cut at multiples of the capacity; a
    whole window is a sequence by itself, and remainders share sequences. Windows of remainders
    are packed where they are read, so nothing is shuffled and memory is bounded. with_ids adds
    the ids themselves (binary, little-endian unsigned 32-bit). A null or empty text is its end_id
    alone; null ids stay null; repeated rows are packed each. Other columns are ignored. The
    tokenizer must not make tokens across white space.
    """
    out = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(
        packer(tokenizer_path, end_id, capacity, with_ids),
        "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
    out = out.withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")
