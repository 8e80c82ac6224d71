"""Readers and writers of the corpus, facts, filings and reports. All schemas are explicit."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.functions.storage import cut, exists, hadoop_path, size_bytes, small
from lodestar.operators.facts import extract_facts
from lodestar.sources.log import Log


def json_lines(spark: SparkSession, paths: str | list[str], schema) -> DataFrame:
    """Rows of JSON lines; blank lines are none."""
    return spark.read.schema(schema).json(paths)


def in_order(spark: SparkSession, paths: str | list[str], schema) -> DataFrame:
    """Rows of JSON lines with file and ordinal: their place, from 0, over all files by name and all lines of each.

    A file is read in blocks by any tasks, and a task reads several. Within a block the number that Spark counts up in a task
    gives the order; blocks, by file and start, are added up to where each begins. No row is sorted or moved for it.
    """
    whole = spark.read.schema(schema).json(paths)
    at, file, start = (fresh(name, whole.columns) for name in ("at", "file", "start"))
    rows = cut(whole.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(start), F.monotonically_increasing_id().alias(at)), "ordered")
    blocks = rows.groupBy(file, start).agg(F.min(at).alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(file, start).rowsBetween(Window.unboundedPreceding, -1))  # a row a block of 128 MB
    blocks = blocks.select(F.col(file).alias("f"), F.col(start).alias("s"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    placed = rows.join(F.broadcast(blocks), (F.col(file) == F.col("f")) & (F.col(start) == F.col("s")))
    return placed.select(*whole.columns, F.col(file).alias("file"), (F.col(at) + F.col("shift")).alias("ordinal"))


def fresh(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def corpus(spark: SparkSession, *folders: str) -> DataFrame:
    """Chunks of all folders, with the file each came from, and ordinal: files by name, lines in order."""
    return in_order(spark, list(folders), schemas.CHUNK)


def eval_set(spark: SparkSession, path: str | list[str], split: str | None = None) -> DataFrame:
    """Entries with ordinal, their order over all files; a split that is asked for must be known and set on all rows."""
    if split not in (None, "dev", "test"):
        raise ValueError(f"no such split: {split}")
    rows = in_order(spark, path, schemas.EVAL_ENTRY).drop("file")
    if split is None:
        return rows
    if n := rows.where("split is null").count():
        raise ValueError(f"{n} entries have no split")
    return rows.where(F.col("split") == split)


def facts(spark: SparkSession, path: str, company: str | None = None) -> DataFrame:
    """Facts stored by company; one company reads its folder only."""
    rows = spark.read.schema(schemas.FACT).parquet(path)
    return rows if company is None else rows.where(F.col("company") == company)


def write_facts(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("company").parquet(path)


def company_facts(spark: SparkSession, path: str, ciks: DataFrame) -> DataFrame:
    """Facts of whole JSON files named <ticker>.json; ciks: (company, cik)."""
    files = spark.read.text(path, wholetext=True).select(F.upper(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).alias("company"), F.col("value").alias("payload"))
    return extract_facts(files.join(small(ciks), "company"))


def submissions(payloads: DataFrame, forms: Iterable[str], first: str, last: str, payload: str = "payload") -> DataFrame:
    """payloads (company, cik, payload JSON) -> the recent filings of the forms, filed within the days, as texts."""
    recent = F.from_json(payload, schemas.SUBMISSIONS)["filings"]["recent"]
    zipped = F.explode(F.arrays_zip(recent["form"], recent["filingDate"], recent["accessionNumber"], recent["primaryDocument"]))
    rows = payloads.select("company", "cik", zipped.alias("f")).select(
        "company", "cik", F.col("f.form").alias("filing_type"), F.col("f.filingDate").alias("filing_date"), F.col("f.accessionNumber").alias("accession_number"), F.col("f.primaryDocument").alias("primary_document")
    )
    kept = rows.where(F.col("filing_type").isin(list(forms)) & F.col("filing_date").between(first, last))
    bare = F.replace("accession_number", F.lit("-"), F.lit(""))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("bigint").cast("string"), F.lit("/"), bare, F.lit("/"), "primary_document")
    return kept.withColumn("document_url", url)


def padded_cik(cik: str, override: str | None = None):
    """Ten digits; a longer number stays as it is. An override comes first."""
    raw = F.col(cik).cast("string") if override is None else F.coalesce(F.col(override).cast("string"), F.col(cik).cast("string"))
    return F.when(F.length(raw) >= 10, raw).otherwise(F.lpad(raw, 10, "0"))


def filings_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): raw bytes, decoded where they are parsed, without the bytes that are no UTF-8."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("html"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files below a folder."""
    return filings_html(spark, path).select("path", F.sha2("html", 256).alias("sha256"))


def write_json(rows: DataFrame, path: str, by: str = "company") -> None:
    rows.write.mode("overwrite").partitionBy(by).json(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not stored yet, of each key one, so that a run can be taken up again; the entries of the log then.

    Rows are written to a folder of their own, which counts once the log names it. A writer that finds its number taken drops
    the keys that the other wrote and tries the next; a run that failed midway leaves a folder that nobody reads.
    """
    spark, log = rows.sparkSession, Log(rows.sparkSession, f"{path}/_log")
    wanted, folder, seen = rows.dropDuplicates([key]), None, -1
    while True:
        numbers = log.numbers()
        if folder is None or len(numbers) != seen:
            known = appended(spark, path, rows.schema, numbers[max(seen, 0) :] if folder else numbers)
            wanted = wanted.join(known.select(key), key, "left_anti").select(*rows.columns)
            folder, seen = f"part-{uuid.uuid4().hex}", len(numbers)
            wanted.write.json(f"{path}/{folder}")
            wanted = spark.read.schema(rows.schema).json(f"{path}/{folder}")
        if log.put(seen, {"folder": folder}):
            return seen + 1


def appended(spark: SparkSession, path: str, schema, numbers: list[int] | None = None) -> DataFrame:
    """The rows that the log names, or those of some of its entries."""
    log = Log(spark, f"{path}/_log")
    folders = [f"{path}/{log.at(n)['folder']}" for n in (log.numbers() if numbers is None else numbers)]
    return spark.read.schema(schema).json(folders) if folders else spark.createDataFrame([], schema)


def create_index(spark: SparkSession, path: str, schema, recreate: bool = False) -> None:
    """An empty index; one that is there stays unless it is to be made anew."""
    spark.createDataFrame([], schema).write.mode("overwrite" if recreate else "ignore").parquet(path)


def index_count(spark: SparkSession, path: str) -> int:
    """The rows of an index as it is now; 0 where there is none."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def copy_index(source: DataFrame, path: str, *columns: str) -> int:
    """Columns of an index under a new path; an error if rows are missing. Their number."""
    spark, n = source.sparkSession, source.count()
    source.select(*columns).write.mode("overwrite").parquet(path)
    if (copied := spark.read.parquet(path).count()) != n:
        raise ValueError(f"{copied} of {n} rows were copied")
    return n


def by_ids(index: DataFrame, ids: DataFrame, *fields: str) -> DataFrame:
    """Fields of the rows with the ids."""
    return index.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", *fields)


def settled_size(spark: SparkSession, path: str, wait: float = 1.0, attempts: int = 30, sleep=time.sleep) -> dict[str, int]:
    """Bytes of an index's data files and of all that its folder holds, once two readings agree; an error if they never do."""
    last = None
    for _ in range(attempts):
        now = {"data": data_bytes(spark, path), "store": size_bytes(spark, path)}
        if now == last:
            return now
        last = now
        sleep(wait)
    raise TimeoutError(f"the size of {path} still changes")


def data_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below path that readers see: neither hidden ones nor marks and logs."""
    fs, p = hadoop_path(spark, path)
    files, total = fs.listFiles(p, True), 0
    while files.hasNext():
        file = files.next()
        inner = file.getPath().toString()[len(fs.makeQualified(p).toString()) :]
        total += 0 if any(part[:1] in (".", "_") and "=" not in part for part in inner.split("/")) else file.getLen()
    return total


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False) + "\n")
