import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import language_model as L
from lodestar.llm import toxicity as T
from lodestar.llm.packing import pack, pack_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_model(texts):
    uni, bi = Counter(), Counter()
    for w in texts:
        uni.update(w)
        bi.update(zip([None, *w[:-1]], w, strict=True))
    d = (0, *L.discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)]))
    ends = Counter(w for _, w in bi)
    e = (0, *L.discounts([sum(c == k for c in ends.values()) for k in (1, 2, 3, 4)]))
    spread = sum(e[min(c, 3)] for c in ends.values()) / max(1, len(bi))
    total, kinds = Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in bi.items():
        total[u] += c
        kinds[u][min(c, 3)] += 1

    def p(u, w):
        low = (ends[w] - e[min(ends[w], 3)]) / len(bi) + spread / (len(uni) + 1)
        if u not in total:
            return low
        c = bi[u, w]
        return (c - d[min(c, 3)]) / total[u] + sum(d[k] * kinds[u][k] for k in (1, 2, 3)) / total[u] * low

    return uni, p


def test_language_model_equals_brute_force(docs):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(80)] + ["É", "Σ", "The"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(150)] + [(200, None), (201, ""), (202, "neverseen again")]
    df = docs(rows)
    model = L.train(df, df["doc_id"] % 3 != 0)
    texts = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in rows}
    uni, p = brute_model([w for i, w in texts.items() if i % 3])
    n, v = sum(uni.values()), len(uni)
    for r in L.score(df, model).collect():
        w = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in uni for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([None, *w[:-1]], w, strict=True)))
    assert sum(p(b"w1", x) for x in uni) + p(b"w1", b"unseen") == pytest.approx(1)


def test_language_model_of_nothing_and_odd_rows(odd, empty):
    rows = L.score(odd, L.train(empty)).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in rows)
    assert L.score(empty, L.train(odd)).collect() == []
    assert all(r["score"] < 0 for r in L.score(odd, L.train(odd)).collect())


def test_counts_survive_their_packing():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    counts = rng.integers(1, 2**33, len(keys)).astype(np.uint64)
    assert all((a == b).all() for a, b in zip(L.unpack_counts(L.pack_counts(keys, counts)), (keys, counts), strict=True))


def sentences(rng, n, toxic):
    words = [f"w{i}" for i in range(300)]
    out = [" ".join(rng.choices(words, k=9)) for _ in range(n)]
    if toxic:
        k = rng.randrange(n)
        out[k] += rng.choice([" nastyone", " nastytwo", " vile"])
        return out, k
    return out, None


def test_toxicity_learns_words_from_documents_and_finds_sentences(spark, docs):
    rng = random.Random(9)
    made = {i: sentences(rng, rng.randrange(1, 30), i % 5 == 0) for i in range(1500)}
    df = docs([(i, ". ".join(s) + ".") for i, (s, _) in made.items()])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in made] + [(0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    from lodestar.llm.queries import held_out

    out = {r["doc_id"]: r for r in T.score(df, T.train(df, labels, ~held_out("id", 3, 1))).collect()}
    test = [i for i in made if held(i)]
    right = sum(out[i]["predicted"] == (i % 5 == 0) for i in test)
    assert right / len(test) > 0.98
    found = [out[i] for i in test if i % 5 == 0 and out[i]["predicted"]]
    texts = {i: ". ".join(s) + "." for i, (s, _) in made.items()}
    hits = [any(made[r["doc_id"]][0][made[r["doc_id"]][1]] in texts[r["doc_id"]][s["start"] : s["end"]] for s in r["sentences"]) for r in found]
    assert sum(hits) / len(hits) > 0.9


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int")
    for model in (T.train(odd, labels), T.train(odd, labels.limit(0)), T.train(empty, labels)):
        rows = T.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert T.score(empty, T.train(odd, labels)).collect() == []


def test_noisy_or():
    assert T.noisy_or(np.array([0.5, 0.5])) == pytest.approx(0.75)
    assert T.sentence_spans("A b. C!\n d v1.2 e") == [(0, 4), (5, 7), (9, 17)]


ODD_TEXTS = ["a <|endoftext|> b <|ENDOFTEXT|>x", "İstanbul ΟΔΟΣ. ΟΔΟΣ, x́y é. Don't I'll 'S 12.3, foo)., bar\xa0baz\x85q \x1cz ...", "ﬁn ǅ. ª º ʰa ß.", "日本語. 한국어,", "😀."]


def test_packing_keeps_every_id_once(spark, docs):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices(["the", "Unlikely", "wörds", "in", "x."], k=rng.choice([0, 3, 50, 2000, 9000])))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(200, None), (201, "")]
    pieces = pack(docs(rows), PATH, 2, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    for i, t in rows:
        own = sorted(by_doc[i], key=lambda p: p["start"])
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert b"".join(p["ids"] for p in own) == np.asarray(ids, "<u4").tobytes()
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))] and own[0]["doc_tokens"] == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))] and sum(p["length"] for p in own) <= 4096


def test_packing_of_odd_rows(odd, empty):
    out = pack(odd, PATH, 2).collect()
    assert sum(r["doc_id"] == 5 for r in out) == 2 and {r["length"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert pack(empty, PATH, 2).collect() == []


def test_bins_are_as_full_as_they_can_be():
    rng = random.Random(11)
    for _ in range(200):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 14))]
        bins = pack_lengths(lengths, 60)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        sums = {0}
        rest = sorted(lengths)[:-1]
        for x in rest:
            sums |= {s + x for s in sums}
        best = max(s for s in sums if s + max(lengths) <= 60) + max(lengths)
        assert sum(lengths[i] for i in bins[0]) == best


def test_fit_takes_one_text_of_an_id(spark):
    from lodestar.llm import toxicity

    rows = [(i, f"word{i % 3} nasty{i % 2} thing. another{i % 5} line") for i in range(60)] + [(i, f"another text {i} nasty0") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1)], "doc_id long, toxic int")
    models = {toxicity.train(spark.createDataFrame(given, "doc_id long, text string").repartition(n), labels) for given, n in ((rows, 1), (rows[::-1], 7))}
    assert len(models) == 1
