import random
import re

import numpy as np
import public_tokenizers
from test_lines_and_quality import brute as brute_lines
from test_lines_and_quality import repeated
from test_near_duplicates import brute as brute_near
from test_scans import edit_distance_inside
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm.decontaminate import budget
from lodestar.llm.quality import BOILERPLATE

SPACE = r"[\x20\x09-\x0D]+"


def split(text):
    return [w for w in re.split(SPACE, text) if w]


def plain_quality(text):
    """The cleaned text, or None if the document goes."""
    text = text or ""
    ws = split(text)
    if len(ws) < 10 or 100 * repeated(ws) > 20 * len(ws):
        return None
    kept = []
    for line in text.split("\n"):
        w = split(line)
        symbols = sum(c in "#*$%&|<>" for c in line)
        bad = w and (
            symbols >= 0.1 * len(line)
            or sum(x in ("|", "»", "›", "•", "·", "/", "::", ">") for x in w) >= 0.25 * len(w)
            or sum(x.endswith("!!") for x in w) >= 0.5 * len(w)
            or len(w) <= 40 and (re.search(BOILERPLATE, line) or len(w) >= 4 and not re.search(r"[.!?…。！？:;\"'”’»)\]][\x20\x09-\x0D]*\Z", line))
        )
        if not bad:
            kept.append(line)
    out = "\n".join(kept)
    return out if len(split(out)) >= 0.5 * len(ws) else None


def words(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def corpus(rng):
    rows, items = [], [(i, words(rng, 25) + ".") for i in range(6)]
    prose = lambda: "\n".join(words(rng, rng.randrange(12, 40)) + "." for _ in range(rng.randrange(1, 6)))
    for i in range(60):
        rows.append((i, prose()))
    for i in range(60, 75):  # copies, whole and in part
        rows.append((i, rows[i - 60][1] if i % 2 else rows[i - 60][1].replace("w1", "q1", 1)))
    for i in range(75, 85):  # the same words in lines that end elsewhere: near duplicates, but no fuzzy lines
        base = [w + "." * (k % 10 == 9) for k, w in enumerate(words(rng, 60).split())]
        rows.append((2 * i, "\n".join(" ".join(base[k : k + 20]) for k in (0, 20, 40))))
        rows.append((2 * i + 1, "\n".join(" ".join(base[max(k, 0) : k + 20]) for k in (-10, 10, 30, 50))))
    for i in range(200, 206):
        rows.append((i, f"{prose()}\n{items[i - 200][1]}\n{prose()}"))
    for i in range(300, 306):
        rows.append((i, f"Home | News | About | Contact\n{prose()}\nAll rights reserved, of course."))
    rows += [(400, "a | b | c | d | e | f | g | h"), (401, "too short"), (402, "again and again and " * 20)]
    return rows, items


def test_stages_equal_plain_versions(spark, docs, tmp_path):
    rng = random.Random(12)
    rows, items = corpus(rng)
    docs(rows).drop("id", "label", "key").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, sf_dir = dict(corpus_pipeline.STAGES), str(tmp_path)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]

    def after(name, given):
        df = docs(sorted(given.items())).drop("id", "label", "key")
        out = stages[name](spark, df, sf_dir)
        assert out.columns == df.columns
        found = {r["doc_id"]: r for r in out.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in found.values())
        return {i: r["text"] for i, r in found.items()}

    text = dict(rows)
    clean = {i: c for i, t in text.items() if (c := plain_quality(t)) is not None}
    assert after("quality_rules", text) == clean and len(clean) < len(text)

    lines = {i: t for i, t in brute_lines(sorted(clean.items())).items() if any(map(split, t.split("\n")))}
    assert after("line_dedup", clean) == lines and len(lines) < len(clean)

    component = brute_near(sorted(lines.items()), 5, 80)
    single = {i: t for i, t in lines.items() if component[i] == i}
    assert after("near_dedup", lines) == single and len(single) < len(lines)

    fold = lambda t: "".join(" " if c.isspace() else c.lower() for c in t)
    pure = {i: t for i, t in single.items() if not any(edit_distance_inside(fold(x), fold(t)) <= budget(len(x)) for _, x in items)}
    assert after("decontamination", single) == pure and len(pure) < len(single)

    def ids_of(pieces):
        out = {}
        for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
            out[p["doc_id"]] = out.get(p["doc_id"], 0) + p["length"]
        return out

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in pure.items()}
    assert ids_of(corpus_pipeline.run(spark, sf_dir).collect()) == want
    assert np.sum(list(want.values())) > 0


def test_stages_take_odd_and_empty_tables(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, None), (2, "nothing of the kind is in there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stay = {"quality_rules": [], "line_dedup": [None, 1, 2, 3, 4, 5, 5, 6], "near_dedup": [None, 1, 2, 3, 4, 5, 6], "decontamination": [None, 1, 2, 3, 4, 5, 5, 6]}
    docs = odd.drop("id", "label", "key")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = [r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()]
        assert sorted(out, key=lambda i: -1 if i is None else i) == stay[name], name
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()} == {None, 1, 2, 3, 4, 5, 6}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.drop("id", "label", "key"), str(tmp_path)).collect() == [], name


def test_rows_that_share_an_id_and_columns_of_any_name(spark, docs, tmp_path):
    rng = random.Random(4)
    one, two, passage = (words(rng, 30) + "." for _ in range(3))
    spark.createDataFrame([(1, passage), (2, "q7 z")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ("kept", "n_words", "clean_text", "n_lines", "document", "row", "component_id", "text_key", "id_", "key_", "own", "start", "item_id")
    df = docs([(1, one), (2, one), (2, two), (7, two), (9, passage), (9, one), (None, passage), (8, "so q7  z")]).drop("id", "label", "key")
    df = df.select("*", *(F.lit(5).alias(c) for c in names))
    stages = dict(corpus_pipeline.STAGES)

    def after(name):
        out = stages[name](spark, df, str(tmp_path))
        rows = out.collect()
        assert out.columns == df.columns and all(r[c] == 5 for r in rows for c in names)
        return sorted((r["doc_id"] or 0, r["text"]) for r in rows)

    assert after("near_dedup") == sorted([(1, one), (2, two), (9, passage), (0, passage), (8, "so q7  z")])
    assert after("decontamination") == sorted([(1, one), (2, one), (2, two), (7, two), (9, one), (8, "so q7  z")])
    assert after("quality_rules") == sorted([(1, one), (2, one), (2, two), (7, two), (9, passage), (9, one), (0, passage)])
    assert len(after("line_dedup")) == 4
