"""Metrics of reports and runs, flattened and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.storage import cut

#: Keys of a report that are no metrics, the longest list that is indexed, and how far metrics may differ.
SKIPPED = frozenset({"per_query", "ground_truth_caveat", "unsupported"})
MOST_ITEMS, TOLERANCE = 100, 1e-9


def flatten(report, prefix: str = "") -> dict[str, float | str]:
    """Dotted scalar leaves of a report; booleans and nulls go, long lists are cut off."""
    out: dict = {}
    if isinstance(report, dict):
        for k, v in report.items():
            if k not in SKIPPED:
                out |= flatten(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(report, (list, tuple)):
        for i, v in enumerate(report[:MOST_ITEMS]):
            out |= flatten(v, f"{prefix}.{i}" if prefix else str(i))
    elif isinstance(report, (int, float)) and not isinstance(report, bool):
        out[prefix] = report
    return out


def flatten_reports(reports: DataFrame, *by: str, report: str = "report") -> DataFrame:
    """(by, metric, value) of a table of reports, as JSON or VARIANT: each number, under its dotted path.

    The same leaves as of flatten: keys in SKIPPED go with all below them, of a list the first MOST_ITEMS count, and
    booleans, nulls and texts are no metrics. Text that is no JSON has none. A round takes all reports a level deeper; there are as many as the deepest has levels.
    """
    value = F.col(report) if reports.schema[report].dataType.simpleString() == "variant" else F.try_parse_json(report)
    level, out = reports.select(*by, F.lit("").alias("metric"), value.alias("value")), None
    while True:
        kind = F.schema_of_variant("value")
        level = cut(level.select("*", kind.alias("kind")).where("kind is not null"), "level")
        numbers = level.where(F.col("kind").rlike("^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)")).select(*by, "metric", F.try_variant_get("value", "$", "double").alias("value"))
        out = numbers if out is None else out.unionByName(numbers)
        deeper = level.where(F.col("kind").rlike("^(OBJECT|ARRAY)"))
        if deeper.isEmpty():
            return out
        items = deeper.select(*by, "metric", F.col("value").alias("of"))
        items = items.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("of").outer()))
        items = items.where(F.when(F.col("key").isNull(), F.col("pos") < MOST_ITEMS).otherwise(~F.col("key").isin(sorted(SKIPPED))))
        name = F.coalesce("key", F.col("pos").cast("string"))
        level = items.select(*by, F.when(F.col("metric") == "", name).otherwise(F.concat("metric", F.lit("."), name)).alias("metric"), "value")


def latest_runs(runs: DataFrame, name: str = "name", created: str = "created_at", state: str = "state") -> DataFrame:
    """Of each name the newest finished run, by the text of its creation time; of equal times the least of the rest."""
    rest = [c for c in runs.columns if c not in (name, created)]
    done = runs.where(F.col(state) == "finished")
    newest = done.groupBy(name).agg(F.max(created).alias(created))
    first = done.join(newest, [name, created]).groupBy(name, created).agg(F.min(F.struct(*rest)).alias("r"))
    return first.select(name, created, *(F.col(f"r.{c}").alias(c) for c in rest))


def compared(one: DataFrame, two: DataFrame, *by: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(by, shared, mismatched, missing_one, missing_two, ok) of metrics (by, metric, value); ok needs a shared metric."""
    keys = [*by, "metric"]
    a, b = (df.select(*keys, F.col("value").alias(n)) for df, n in ((one, "a"), (two, "b")))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), keys, "full")
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    counts = both.groupBy(*by).agg(
        F.count_if(shared).alias("shared"),
        F.count_if(shared & (F.abs(F.col("a") - F.col("b")) > tolerance)).alias("mismatched"),
        F.count_if(F.col("in_a").isNull()).alias("missing_one"),
        F.count_if(F.col("in_b").isNull()).alias("missing_two"),
    )
    return counts.withColumn("ok", (F.col("shared") > 0) & (F.col("mismatched") + F.col("missing_one") + F.col("missing_two") == 0))


def verified_runs(expected: DataFrame, latest: DataFrame) -> DataFrame:
    """(name, found): each expected run, and whether there is a finished one."""
    return expected.select("name").join(latest.select("name", F.lit(True).alias("found")), "name", "left").fillna(False, ["found"])


def histogram(values: DataFrame, column: str, edges: tuple[float, ...]) -> DataFrame:
    """(le, n): cumulative counts by upper edge, the last without bound."""
    counts = [F.count_if(F.col(column) <= e).alias(str(i)) for i, e in enumerate(edges)]
    row = values.agg(*counts, F.count(column).alias(str(len(edges))))
    pairs = F.array(*(F.struct(F.lit(float(e)).alias("le"), F.col(str(i)).alias("n")) for i, e in enumerate((*edges, float("inf")))))
    return row.select(F.explode(pairs).alias("x")).select("x.*")
