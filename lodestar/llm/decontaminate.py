"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, small, text_or_empty

Q = 8
#: Edits a passage may have, as a share of the item's characters.
EDITS = 0.10
FILTER_BITS = 23
#: Characters of items that are sent to the workers at once; more items are searched in blocks of this size.
BLOCK_CHARS = 8_000_000
#: Characters of documents worked on at once.
CHUNK_CHARS = 1_000_000
PRIME = 0x9E3779B97F4A7C15


def folding() -> np.ndarray:
    """Code points below 0x3000 in lower case, white space as a space. Lengths stay."""
    out = np.arange(0x3000, dtype=np.uint32)
    for i in range(0x3000):
        low = chr(i).lower()
        out[i] = 32 if chr(i).isspace() else ord(low) if len(low) == 1 else i
    return out


def code_points(text: str, fold: np.ndarray) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < len(fold), fold[np.minimum(x, len(fold) - 1)], x)


def qgrams(x: np.ndarray) -> np.ndarray:
    """Hashes of the Q = 8 characters that start at each place, by doubling."""
    h, power = x.astype(np.uint64) + np.uint64(1), PRIME
    for step in (1, 2, 4):
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power % 2**64
    return h


def budget(length: int) -> int:
    """Edits that a passage of an item may have."""
    return int(EDITS * length)


class Items:
    """The items of a block with their q-grams, sorted; short ones, whose passages may share no q-gram, apart."""

    def __init__(self, items: list[tuple[int, str]]):
        self.fold = folding()
        self.ids, self.codes, self.short = [], [], []
        for i, text in items:
            text = text or ""
            lead = len(text) - len(text.lstrip())
            codes = code_points(text.strip(), self.fold) if lead < len(text) else np.empty(0, np.uint32)
            if len(codes) and budget(len(codes)) > (len(codes) - Q) // Q:
                self.short.append((i, codes, budget(len(codes))))
            elif len(codes):
                self.ids.append(i)
                self.codes.append(codes)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([budget(n) for n in self.length], np.int64)
        self.least = self.length + 1 - Q - Q * self.edits
        grams = [qgrams(c) for c in self.codes]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        hashes = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hashes, self.first = np.unique(hashes[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in x, item, place in the item) of every shared q-gram."""
        h = qgrams(x)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if len(at) and len(self.hashes):
            found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            same = self.hashes[found] == h[at]
            at, found = at[same], found[same]
        else:
            at = found = np.empty(0, np.int64)
        n = self.first[found + 1] - self.first[found]
        which = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[which], self.place[which]

    def regions(self, x: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, least and greatest diagonal) of the bands that hold enough shared q-grams.

        x joins documents, starts has where each begins. Bands of twice the edit budget overlap by
        half, so the diagonals of an alignment within the budget lie in one of them.
        """
        at, item, place = self.hits(x)
        if not len(at):
            return []
        doc = np.searchsorted(starts, at, side="right") - 1
        diagonal = at - place
        width = self.edits[item] + 1
        band = np.floor_divide(diagonal, width)
        # a band is named by its lower half; a hit lies in that of its own half and of the one below
        doc, item, diagonal, place = (np.concatenate([v, v]) for v in (doc, item, diagonal, place))
        band = np.concatenate([band, band - 1])
        order = np.lexsort((diagonal, band, item, doc))
        doc, item, band, diagonal, place = (v[order] for v in (doc, item, band, diagonal, place))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)]))
        size = np.diff(np.append(new, len(doc)))
        last = new + size - 1
        out = []
        for a, b in zip(*(v[size >= self.least[item[new]]].tolist() for v in (new, last)), strict=True):
            # a q-gram that the item has once counts once, however often the text has it
            if len(np.unique(place[a : b + 1])) >= self.least[item[a]]:
                out.append((int(doc[a]), int(item[a]), int(diagonal[a]), int(diagonal[b])))
        return out


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of item in text on diagonals low - most to high + most.

    Ends in text are free. Of equal edits the first end, then the shortest span. None beyond most.
    """
    for d in range(max(low, 0), min(high, len(text) - len(item)) + 1):
        if text[d] == item[0] and np.array_equal(text[d : d + len(item)], item):
            return 0, d, d + len(item)
    low, high = max(low - most, -most), min(high + most, len(text) - len(item) + most)
    if high < low:
        return None
    # row i, cell d stands for text[: i + low + d]; beyond the text are cells that are never better
    width, inf, n = high - low + 1, 1 << 30, len(item)
    offset = np.arange(width)
    padded = np.full(width + n + 1, 0xFFFFFFFE, np.uint32)  # padded[k] is text[low + k - 1]
    left, right = max(low - 1, 0), min(low + n + width - 1, len(text))
    padded[left - low + 1 : right - low + 1] = text[left:right]
    beyond = np.zeros(width + n + 1, np.int64)
    beyond[: max(0, -low)] = inf
    beyond[max(0, len(text) - low + 1) :] = inf
    row, start = beyond[:width].copy(), offset + low
    down, from_down = np.full(width, inf), np.zeros(width, np.int64)
    for i, c in enumerate(item, 1):
        best = row + (padded[i : i + width] != c)
        np.add(row[1:], 1, out=down[:-1])  # a character of the item that the text lacks
        from_down[:-1] = start[1:]
        best, origin = np.minimum(best, down), np.where(down < best, from_down, start)
        best = np.maximum(best, beyond[i : i + width])
        # characters of the text that the item lacks, from the left
        run = best - offset
        least = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == least, offset, 0))
        row, start = least + offset, origin[source]
    end = int(np.argmin(row))
    if row[end] > most:
        return None
    return int(row[end]), int(start[end]), end + low + len(item)


def everywhere(item: np.ndarray, text: np.ndarray, most: int, base: int = 0) -> list[tuple[int, int, int]]:
    """(edits, start, end) of all places of an item in a text, the best first, then those beside it."""
    out, left = [], [(text, base)]
    while left:
        part, at = left.pop()
        hit = align(item, part, 0, len(part) - len(item), most) if len(part) >= len(item) - most else None
        if hit:
            edits, start, end = hit
            out.append((edits, at + start, at + end))
            left += [(part[end:], at + end), (part[:start], at)]
    return out


def searcher(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(held.value)

        def search(ids: list, codes: list[np.ndarray]) -> list[tuple]:
            # a character of no item keeps documents apart
            gap = np.array([0xFFFFFFFF], np.uint32)
            x = np.concatenate([v for c in codes for v in (c, gap)] + [np.repeat(gap, Q)])
            starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in codes])[:-1]])
            found = {}
            for doc, item, low, high in items.regions(x, starts):
                base = int(starts[doc])
                hit = align(items.codes[item], codes[doc], low - base, high - base, int(items.edits[item]))
                if hit:
                    key = (doc, item)
                    # overlapping bands find one passage twice
                    kept = found.setdefault(key, [])
                    clash = [k for k in kept if k[1] < hit[2] and hit[1] < k[2]]
                    if all(hit < k for k in clash):
                        found[key] = [k for k in kept if k not in clash] + [hit]
            rows = [(ids[d], items.ids[i], a, b, e) for (d, i), hits in found.items() for e, a, b in sorted(hits, key=lambda h: h[1])]
            for i, text in zip(ids, codes, strict=True):
                for item, short, most in items.short:
                    rows += [(i, item, a, b, e) for e, a, b in sorted(everywhere(short, text, most), key=lambda h: h[1])]
            return rows

        for batch in batches:
            rows, ids, codes, size = [], [], [], 0
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                codes.append(code_points(text.as_py(), items.fold))
                size += len(codes[-1])
                if size > CHUNK_CHARS:
                    rows += search(ids, codes)
                    ids, codes, size = [], [], 0
            if ids:
                rows += search(ids, codes)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "item", "start", "end", "edits"])

    return run


def find_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per passage: (id, item, start, end, edits), in code points of the document.

    A passage is a span of the text whose edit distance to an item, in lower case and with any
    white space as a space, is a tenth of the item's length at most; of overlapping spans of one
    item the best is kept. Short items, of which a passage may share no q-gram, are aligned with
    every text whole. Null and empty texts and items have no passage; null ids stay
    null; repeated rows give repeated results. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    chars = items.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    out = None
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in own.toLocalIterator()])
        found = source.mapInArrow(searcher(held), "id long, item long, start long, end long, edits long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark.

    Each row is judged by its own text, whatever its id is and however many rows share that; rows
    with a null or empty text stay.
    """
    mark = fresh("row", docs.columns)
    keyed = docs.withColumn(mark, F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col)))
    found = find_passages(keyed.select(mark, text_col), benchmark, mark, text_col, **names)
    return keyed.join(small(found.select(mark).distinct()), mark, "left_anti").select(*docs.columns)
