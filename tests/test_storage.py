import json
import threading

import pytest
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.functions import storage
from lodestar.sources import buckets, files, log
from lodestar.sources.buckets import BucketedIndex
from lodestar.streaming.ingest import bucketed_stream

ROW = "k string, v string"


def frame(spark, *rows, schema=ROW):
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture()
def index(spark, tmp_path):
    return BucketedIndex.create(spark, str(tmp_path / "index"), frame(spark).schema, "k", 8)


def content(index, version=None):
    return {r["k"]: r["v"] for r in index.read(version).collect()}


def test_an_entry_is_put_once(spark, tmp_path):
    path = str(tmp_path / "log" / "a.json")
    assert storage.put_new(spark, path, "one") and not storage.put_new(spark, path, "two")
    assert storage.read_text(spark, path) == "one" and storage.names(spark, str(tmp_path / "log")) == ["a.json"]
    assert log.Log(spark, str(tmp_path / "none")).latest() is None


def test_a_batch_of_one_key_rewrites_one_bucket(spark, index):
    assert content(index) == {} and index.upsert(frame(spark, *((f"k{i}", "old") for i in range(100)))) == 1
    before = index.manifest()[1]["folders"]
    assert len(before) == 8 and index.upsert(frame(spark, ("k7", "new"))) == 2
    after = index.manifest()[1]["folders"]
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and storage.names(spark, f"{index.path}/data/{after[changed[0]]}") == ["_SUCCESS", f"_bucket={changed[0]}"]
    assert content(index) == {f"k{i}": "new" if i == 7 else "old" for i in range(100)}
    assert set(content(index, 1).values()) == {"old"}  # the version before is there still


def test_a_crash_between_write_and_switch_leaves_the_old_version(spark, index, monkeypatch):
    index.upsert(frame(spark, ("a", "1"), ("b", "1")))
    monkeypatch.setattr(log, "put_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        index.upsert(frame(spark, ("a", "2")))
    monkeypatch.undo()
    assert content(index) == {"a": "1", "b": "1"} and len(storage.names(spark, f"{index.path}/data")) == 2
    assert len(index.vacuum()) == 1 and content(index) == {"a": "1", "b": "1"}  # what it left behind goes
    index.upsert(frame(spark, ("a", "2")))
    assert content(index) == {"a": "2", "b": "1"}


def test_writers_at_once_lose_nothing(spark, index):
    index.upsert(frame(spark, ("x", "0")))
    errors = []

    def write(i):
        try:
            index.upsert(frame(spark, (f"w{i}", str(i)), ("x", str(i))))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = content(index)
    assert not errors and {k: v for k, v in found.items() if k != "x"} == {f"w{i}": str(i) for i in range(3)} and found["x"] in "012" and index.manifest()[0] == 4


def test_of_a_batch_the_last_row_of_a_key_stays(spark, index):
    both = frame(spark, ("a", "9", 1), ("a", "1", 2), schema="k string, v string, n int")
    index.upsert(both, order="n")
    assert content(index) == {"a": "1"}
    index.upsert(both)
    assert content(index) == {"a": "9"}
    with pytest.raises(Exception, match="a row has no key"):
        index.upsert(frame(spark, (None, "x")))
    assert index.upsert(frame(spark)) == index.manifest()[0] == 2  # no rows, no version


def test_a_lookup_reads_the_buckets_of_its_keys(spark, index):
    index.upsert(frame(spark, *((f"k{i}", str(i)) for i in range(100))))
    found = index.lookup(frame(spark, ("k3",), ("none",), schema="k string"))
    assert [tuple(r) for r in found.collect()] == [("k3", "3")] and 1 <= len({f.rsplit("/", 2)[-2] for f in found.inputFiles()}) <= 2


def test_indexes_are_made_once(spark, index):
    with pytest.raises(ValueError, match="there is an index"):
        BucketedIndex.create(spark, index.path, frame(spark).schema, "k")
    with pytest.raises(ValueError, match="needs a column"):
        BucketedIndex.create(spark, index.path + "2", frame(spark).schema, "id")
    with pytest.raises(ValueError, match="no index"):
        BucketedIndex(spark, index.path + "2").read()
    with pytest.raises(ValueError, match="no version 5"):
        index.read(5)


def test_a_stream_upserts_each_batch_once(spark, tmp_path):
    schema = frame(spark).schema
    index = BucketedIndex.create(spark, str(tmp_path / "index"), schema, "k", 4)
    (tmp_path / "in").mkdir()
    for name, rows in (("1", [("a", "1"), ("b", "1")]), ("2", [("b", "2"), ("c", "2")])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))
        bucketed_stream(spark, str(tmp_path / "in"), index, str(tmp_path / "point"), "chunks", schema).awaitTermination()
    assert content(index) == {"a": "1", "b": "2", "c": "2"} and index.manifest()[0] == 2
    assert index.upsert(frame(spark, ("b", "old")), epoch=("chunks", 1)) == 2 and content(index)["b"] == "2"  # the batch comes again
    assert index.upsert(frame(spark, ("b", "3")), epoch=("other", 0)) == 3 and content(index)["b"] == "3"


def test_appends_of_a_failed_run_are_taken_up(spark, tmp_path):
    path, rows = str(tmp_path / "out"), spark.range(40).select("id", F.lit("t").alias("t"))
    broken = rows.repartition(4).withColumn("t", F.when(F.col("id") == 33, F.raise_error(F.lit("task lost"))).otherwise(F.col("t")))
    files.append_new(rows.where("id < 10"), path, "id")
    with pytest.raises(Exception, match="task lost"):
        files.append_new(broken, path, "id")
    assert files.appended(spark, path, rows.schema).count() == 10
    files.append_new(rows.union(rows), path, "id")
    assert sorted(r["id"] for r in files.appended(spark, path, rows.schema).collect()) == list(range(40))
    assert files.appended(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_two_writers_append_each_key_once(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "out"), "id long, t string"
    taken, put = [], log.put_new

    def late(session, name, text):  # another writer comes in between our reading and our entry
        if not taken:
            taken.append(1)
            files.append_new(frame(spark, (2, "other"), (3, "other"), schema=schema), path, "id")
        return put(session, name, text)

    monkeypatch.setattr(log, "put_new", late)
    assert files.append_new(frame(spark, (1, "mine"), (2, "mine"), schema=schema), path, "id") == 2
    assert sorted(tuple(r) for r in files.appended(spark, path, frame(spark, schema=schema).schema).collect()) == [(1, "mine"), (2, "other"), (3, "other")]


def test_order_is_that_of_the_files_over_many_splits(spark, tmp_path):
    n = 0
    for name in ("a", "b", "c"):
        lines = []
        for _ in range(700 if name == "b" else 90):
            lines.append(json.dumps({"eval_id": str(n), "question": "q" * (n % 50), "split": "dev" if n % 3 else "test"}))
            n += 1
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        rows = files.eval_set(spark, str(tmp_path))
        assert spark.read.schema(schemas.EVAL_ENTRY).json(str(tmp_path)).rdd.getNumPartitions() > 10
        assert [(r["ordinal"], r["eval_id"]) for r in rows.orderBy("ordinal").collect()] == [(i, str(i)) for i in range(n)]
        dev = files.eval_set(spark, str(tmp_path), "dev")
        assert [r["eval_id"] for r in dev.orderBy("ordinal").collect()] == [str(i) for i in range(n) if i % 3]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_corpus_keeps_order_and_files(spark, tmp_path):
    for name, ids in (("y", "cd"), ("x", "ab")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text("\n".join(json.dumps({"chunk_id": i}) for i in ids))
    rows = files.corpus(spark, str(tmp_path / "y"), str(tmp_path / "x")).orderBy("ordinal").collect()
    assert [r["chunk_id"] for r in rows] == list("abcd") and rows[0]["file"].endswith("x/1.json")


def test_broadcasts_are_for_few_rows_and_few_bytes(spark, monkeypatch):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(storage.small(spark.range(10)))
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 10)
    assert not hinted(storage.small(spark.range(10)))


def test_conflicts_end(spark, index, monkeypatch):
    monkeypatch.setattr(log, "put_new", lambda *a: False)
    with pytest.raises(buckets.Conflict):
        index.upsert(frame(spark, ("a", "1")))
