import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same

import lodestar.llm.resample as resampling
from lodestar.llm import queries, spelling
from lodestar.llm.resample import column_sums, csr_blocks, resample
from lodestar.llm.shared import new_path
from lodestar.llm.spelling import near_words, parities, spelling_variants
from lodestar.llm.token_counts import Pieces, counter, stored_counts, token_counts, tokenizer_version

DIR = "/root/testdata/sf0.001"
PIECES, WORDS, BYTES = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@tables
@pytest.mark.parametrize("name", ["op12_resampling", "op13_spelling_variants"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, name, sf):
    d = DIR.replace("sf0.001", sf)
    assert_same(queries.QUERIES[name](spark, d), queries.ORACLE_SQL[name], d)


# --- token counts


def whole_counts(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


@tables
def test_token_counts_equal_those_of_the_library(spark):
    d = DIR.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = whole_counts(PIECES, [r["text"] or "" for r in rows])
    out = queries.QUERIES["op11_token_counts"](spark, d)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    found = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    assert found == Counter((r["doc_id"], len((r["text"] or "").encode()), n, n > 4096) for r, n in zip(rows, want, strict=True))


def test_words_by_themselves_count_as_within_their_text():
    rng = random.Random(5)
    parts = [" ", "  ", "   ", "a", "the", "Ünïcode", "\n", "\t", "　", " ", "▁", "<s>", "</s>", "<unk>", "😀", "é", "1234", "x" * 40, ".", "-", "(", "日本語", "\x00", "\r\n", "' ", "in", "g"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)] + ["", " ", "  ", "x" * 20_000, " a" * 20_000]
    pieces = Pieces(PIECES)
    assert pieces.apart and pieces(texts) == whole_counts(PIECES, texts)


def test_token_counts_of_other_tokenizers(spark, docs):
    texts = ["", "Hello  World", "<|endoftext|> and <|startoftext|>", "aé 日本", None]
    for path in (WORDS, BYTES):
        out = token_counts(docs(list(enumerate(texts))), path, new_path(spark, "cache"))
        assert [r["n_tokens"] for r in out.orderBy("doc_id").collect()] == whole_counts(path, [t or "" for t in texts])
    with pytest.raises(ValueError, match="no library"):
        counter("words.txt")


def test_the_cache_takes_each_new_text_once_and_gives_it_back(spark, docs):
    cache, version = new_path(spark, "cache"), tokenizer_version(PIECES)
    one = docs([(1, "alpha beta"), (2, "alpha beta"), (3, None), (None, "no id"), (None, "no id"), (4, "same"), (4, "same"), (4, "other")])
    first = token_counts(one, PIECES, cache).collect()
    raw = lambda: spark.read.parquet(f"{cache}/tokenizer={version}")
    assert len(first) == 8 and raw().count() == 5 == stored_counts(one, cache, version).count()
    two = docs([(9, "alpha beta"), (10, "new")])
    # what is stored is believed: a planted count comes back
    planted = spark.createDataFrame([(bytes.fromhex(hashlib.sha256(b"planted").hexdigest()), 77)], "content binary, n_tokens long")
    planted.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    out = {r["doc_id"]: r["n_tokens"] for r in token_counts(two.union(docs([(11, "planted")])), PIECES, cache).collect()}
    assert out == {9: whole_counts(PIECES, ["alpha beta"])[0], 10: whole_counts(PIECES, ["new"])[0], 11: 77}
    assert raw().count() == 7
    # the same rows appended by another run do no harm, and another tokenizer has counts of its own
    raw().limit(3).write.mode("append").parquet(f"{cache}/tokenizer={version}")
    assert len(token_counts(one, PIECES, cache).collect()) == 8
    assert {r["n_tokens"] for r in token_counts(docs([(1, "planted")]), WORDS, cache).collect()} == set(whole_counts(WORDS, ["planted"]))


def test_normalised_contents_are_counted_once(spark, docs):
    cache = new_path(spark, "cache")
    out = token_counts(docs([(1, "One  TWO"), (2, " one two ")]), WORDS, cache, normalise=lambda t: F.lower(F.regexp_replace(F.trim(t), " +", " "))).collect()
    assert [r["n_tokens"] for r in out] == [2, 2] and {r["n_bytes"] for r in out} == {8, 9}
    assert spark.read.parquet(cache).count() == 1


def test_token_counts_of_odd_and_no_rows(spark, odd, empty):
    rows = odd.collect()
    out = token_counts(odd, PIECES, new_path(spark, "cache")).collect()
    want = whole_counts(PIECES, [r["text"] or "" for r in rows])
    key = lambda x: (x[0] is not None, x)
    assert sorted([(r["doc_id"], r["n_tokens"]) for r in out], key=key) == sorted(zip([r["doc_id"] for r in rows], want, strict=True), key=key)
    assert token_counts(empty, PIECES, new_path(spark, "cache")).count() == 0


# --- resampling


def plain_resample(rows, target, least=20, percent=25):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2) for i in range(len(w) - n + 1)]

    mine, other = [found(t) for _, t in rows], [x for t in target for x in found(t)[1]]
    s, t = Counter(x for _, f in mine for x in f), Counter(other)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for (i, _), (n, f) in zip(rows, mine, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    for rank, x in enumerate(order[: percent * len(order) // 100], 1):
        x[4] = (rank,)
    return Counter((*x[:4], x[4][0] if isinstance(x[4], tuple) else None) for x in out)


def test_resampling_equals_plain_counting(spark, docs):
    rng = random.Random(3)
    vocabulary = [*("w%d Ärger LOUD it's x1 日本 ok" % 7).split(), *(f"term{i}" for i in range(200))]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(5, rows[5][1]), (None, "nobody " * 30), (None, "nobody " * 30), (901, None), (902, ""), (903, "long words " * 30_000)]
    target = ["term1 term2 term3 " * 9, None, "Ärger"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = resample(docs(rows).repartition(5), bench)
    assert Counter(tuple(r) for r in out.collect()) == plain_resample(rows, target)


def test_blocks_hold_the_matrix(spark, docs):
    blocks = csr_blocks(docs([(1, "a b a b"), (2, ""), (3, "c")]).coalesce(1), buckets=1000).collect()
    b, code = blocks[0], lambda s: zlib.crc32(s.encode()) % 1000
    assert len(blocks) == 1 and b["ids"] == [1, 2, 3] and b["n_words"] == [4, 0, 1]
    entries = list(zip(b["buckets"], b["counts"], strict=True))
    assert sorted(entries[: b["starts"][1]]) == sorted({code("a"): 2, code("b"): 2, code("a b"): 2, code("b a"): 1}.items())
    assert b["starts"][1] == b["starts"][2] and entries[b["starts"][2] :] == [(code("c"), 1)]
    sums = column_sums(csr_blocks(docs([(1, "a"), (2, "a b")]), buckets=1000), 1000)
    assert {r["bucket"]: r["n"] for r in sums.collect()} == {code("a"): 2, code("b"): 1, code("a b"): 1}


def test_the_stored_matrix_is_read_in_parts_of_bounded_size(spark, docs, monkeypatch):
    written, plain = [], resampling.cut
    monkeypatch.setattr(resampling, "cut", lambda *a, **k: written.append(plain(*a, **k)) or written[-1])
    rows = [(i, f"w{i} " * 26_000) for i in range(40)]  # a block each
    found = resample(docs(rows).coalesce(1), spark.createDataFrame([(1, "w1")], "item_id long, text string"))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written[0].inputFiles()]
    sizes = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(sizes) == 40 and max(sizes) <= 16 and found.where("n_features = 51999").count() == 40


def test_resampling_of_no_rows_and_of_no_target(spark, odd, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resample(empty, bench).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(tuple(r) for r in resample(odd, bench).collect()) == plain_resample(rows, [])


# --- spelling variants


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def varied(rng, n):
    base = ["".join(rng.choice("abcdeèÿÀ÷") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    more = []
    for w in base:
        i = rng.randrange(len(w))
        more += [w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdé") + w[i:], w[:i] + rng.choice("abcdé") + w[i + 1 :], w.upper()]
    return [(i, ", ".join(rng.choices(base, k=30) + rng.choices(more, k=25))) for i in range(n)]


@pytest.mark.parametrize("cell", [2000, 3])
def test_variants_equal_all_pairs(docs, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)  # small cells: every bucket is dealt out
    rows = varied(random.Random(cell), 120) + [(None, "nobody nobody nobodi nobodi nobodi"), (500, None), (500, "")]
    out = spelling_variants(docs(rows)).collect()
    assert len(out) > 200 and {tuple(r) for r in out} == plain_variants(rows)


def test_forms_are_followed_to_the_root(docs):
    sizes = {"abcdefg": 3, "abcdefgh": 6, "abcdefghi": 12, "abcdefghij": 24, "abcdefghijk": 48, "zzzzz": 5}
    out = {r["word"]: r for r in spelling_variants(docs([(7, " ".join(" ".join([w] * n) for w, n in sizes.items()))])).collect()}
    assert {w: r["root"] for w, r in out.items() if len(w) > 5} == dict.fromkeys([w for w in out if len(w) > 5], "abcdefghijk")
    assert out["zzzzz"]["form"] is None and out["zzzzz"]["root"] == "zzzzz" and out["zzzzz"]["n_near"] == 0


def test_one_edit_flips_at_most_two_parities(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéÿ") for _ in range(8))
        i = rng.randrange(8)
        rows += [(w, w[:i] + w[i + 1 :], 1), (w, w[:i] + rng.choice("qzÿ") + w[i + 1 :], 2), (w, w[:i] + "ü" + w[i:], 1)]
    pairs = spark.createDataFrame(rows, "a string, b string, most int")
    flipped = pairs.select("most", F.bit_count(parities(F.col("a")).bitwiseXOR(parities(F.col("b")))).alias("k"))
    assert flipped.where("k > most").isEmpty()


def test_near_words_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 50)
    from itertools import permutations

    words = ["".join(p) for p in permutations("abcdef")] + ["abcdefg", "abcde"]  # one mask for 720 words
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    found = {(r["word"], r["near"]) for r in near_words(df).collect()}
    assert found == {(a, b) for a in words for b in words if distance_one(a, b)}


def test_variants_of_odd_and_no_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in spelling_variants(odd).collect()} == plain_variants(rows)
    assert spelling_variants(empty).count() == 0
