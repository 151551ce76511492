"""Nested result documents as VARIANT columns: unnesting of any depth, and the completeness audit of temporal runs.

A missing key and a key that holds null are different things here: recorded metrics may be null (a ranking measure of a
one-class period), but may not be absent.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.audit import REQUIRED_METADATA, REQUIRED_METRICS, REQUIRED_MODELS, REQUIRED_PACKAGES, REQUIRED_STRATEGIES

PERIODS = ("backtest", "forward")
# What the strict audit asks of a strategy's record and of a calibration.
STRATEGY_METRICS = ("precision", "recall", "f1", "false_positive_rate")
CALIBRATION_METRICS = ("brier", "ece")
MARK = "#"
PROBLEM = ("run", "check", "item", "value")


def parsed(text: Column) -> Column:
    """A document as VARIANT. Bare NaN and infinities, which JSON does not have, become marked strings; broken text is null."""
    quoted = F.regexp_replace(text, r"(?<=[:\[,])(\s*)(-?Infinity|NaN)(?=\s*[,\]}])", f'$1"{MARK}$2"')
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(quoted))


def at(document: Column, path: str) -> Column:
    """The value at a path: SQL null where there is no such key, a VARIANT null where it holds null."""
    return F.try_variant_get(document, f"$.{path}", "variant")


def text_at(document: Column, path: str) -> Column:
    return F.try_variant_get(document, f"$.{path}", "string")


def is_a(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def blank(value: Column) -> Column:
    """Absent, null, an empty text, or an object or list without members."""
    kind = F.schema_of_variant(value)
    return F.coalesce(kind.isin("VOID", "OBJECT<>", "ARRAY<VOID>") | ((kind == "STRING") & (value.cast("string") == "")), F.lit(True))


def members(df: DataFrame, value: Column) -> DataFrame:
    """The rows with pos, key and value of every member of an object or list; others have none."""
    keep = [c for c in df.columns if c not in ("pos", "key", "value")]
    rows = df.select(*keep, value.alias("_document"))
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_document").outer())).select(*keep, "pos", "key", "value")


def leaves(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(by, path, kind, value) of every value in a document that is not an object or list with members.

    One level of all documents is unnested at a time; the loop ends with the deepest document.
    """
    level = df.select(*by, F.lit("").alias("path"), F.col(column).alias("value")).where(F.col("value").isNotNull())
    found = []
    while True:
        kind = F.schema_of_variant("value")
        nested = (kind.startswith("OBJECT<") | kind.startswith("ARRAY<")) & ~kind.isin("OBJECT<>", "ARRAY<VOID>")
        found.append(level.where(~nested).select(*by, "path", kind.alias("kind"), F.col("value").cast("string").alias("value")))
        inner = level.where(nested)
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found)
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise(
            F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("key")))
        level = members(inner, F.col("value")).select(*by, F.concat("path", step).alias("path"), "value")


def bad_leaves(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(by, path, value) of every number in a document that is NaN or infinite."""
    rows = leaves(df, by, column)
    marked = F.col("value").isin(*[MARK + v for v in ("NaN", "Infinity", "-Infinity")])
    return rows.where((F.col("kind") == "STRING") & marked).select(*by, "path", F.substring("value", 2, 20).alias("value"))


def run_problems(runs: DataFrame, calibrations: DataFrame, strict: bool = False) -> DataFrame:
    """(run, check, item, value) of incomplete temporal runs.

    ``runs``: run, metadata, metrics (documents as VARIANT, null where there is no file), drift_table (is there one).
    ``calibrations``: run, model, document. A run without metrics never finished, and a superseded one counts no more: they
    have that one problem. ``strict`` also asks for all models, strategies and their measures.
    """
    problems = []

    def add(rows: DataFrame, check: str, item: Column | str = "", value: Column | None = None) -> None:
        item = F.lit(item) if isinstance(item, str) else item
        problems.append(rows.select("run", F.lit(check).alias("check"), item.alias("item"),
                                    (F.lit(None).cast("string") if value is None else value).alias("value")))

    def absent(rows: DataFrame, check: str, missing: dict[str, Column], *prefix: Column) -> None:
        names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in missing.items()]))
        listed = rows.select(*rows.columns, F.explode(names).alias("_item"))
        add(listed, check, F.concat_ws(".", *prefix, "_item"))

    metadata, metrics = F.col("metadata"), F.col("metrics")
    add(runs.where(metrics.isNull()), "unfinished")
    superseded = ~blank(at(metadata, "superseded"))
    finished = runs.where(metrics.isNotNull())
    add(finished.where(superseded), "superseded", value=F.substring(F.coalesce(text_at(metadata, "superseded.reason"), F.lit("")), 1, 120))
    live = finished.where(~superseded)

    absent(live, "metadata", {c: blank(at(metadata, c)) for c in REQUIRED_METADATA})
    versions = {p: F.coalesce(F.try_variant_get(metadata, f"$.package_versions['{p}']", "string"), F.lit("")).isin("", "not installed") for p in REQUIRED_PACKAGES}
    absent(live, "package_version", versions)
    absent(live, "temporal_split", {f"{p}_period": blank(at(metadata, f"temporal_split.{p}_period")) for p in ("train", "validation", *PERIODS)})
    count = F.try_variant_get(metadata, "$.temporal_split.train_count", "double")
    absent(live, "temporal_split", {"train_count": F.coalesce(count == 0, F.lit(True))})
    add(live.where(blank(at(metrics, "drift_summary"))), "drift_summary")
    add(live.where(~F.coalesce(F.col("drift_table"), F.lit(False))), "drift_table")

    models = members(live.select("run", "metrics"), at(metrics, "models")).withColumn(
        "model", F.coalesce(text_at(F.col("value"), "result.model"), F.lit("?")))
    add(live.join(models, "run", "left_anti"), "models")
    for period in PERIODS:
        block = at(F.col("value"), f"result.{period}")
        add(models.where(~is_a(block, "OBJECT<")), "period", F.concat_ws(".", "model", F.lit(period)))
        held = models.where(is_a(block, "OBJECT<"))
        absent(held, "metric", {c: at(block, c).isNull() for c in REQUIRED_METRICS}, F.col("model"), F.lit(period))
    bad = bad_leaves(models, ["run", "model"], "value")
    add(bad, "number", F.concat_ws(".", "model", "path"), F.col("value"))

    known = models.select("run", "model").distinct().join(calibrations, ["run", "model"], "left")
    add(known.where(F.col("document").isNull()), "calibration", F.col("model"))
    for period in PERIODS:
        for c in CALIBRATION_METRICS:
            value = at(F.col("document"), f"{period}.{c}")
            item = F.concat_ws(".", "model", F.lit(period), F.lit(c))
            add(known.where(F.col("document").isNotNull() & F.coalesce(F.is_variant_null(value), F.lit(True))), "calibration_metric", item)
            add(known.where(value.cast("string").startswith(MARK)), "calibration_number", item, F.substring(value.cast("string"), 2, 20))
    if strict:
        wanted = live.select("run", F.explode(F.array(*[F.lit(m) for m in REQUIRED_MODELS])).alias("model"))
        add(wanted.join(models, ["run", "model"], "left_anti"), "required_model", F.col("model"))
        records = members(models.select("run", "model", "value"), at(F.col("value"), "adaptation.strategies")).withColumn(
            "strategy", F.coalesce(text_at(F.col("value"), "strategy"), F.lit("?")))
        wanted = models.select("run", "model", F.explode(F.array(*[F.lit(s) for s in REQUIRED_STRATEGIES])).alias("strategy")).distinct()
        add(wanted.join(records, ["run", "model", "strategy"], "left_anti"), "required_strategy", F.concat_ws(".", "model", "strategy"))
        objects = records.where(is_a(F.col("value"), "OBJECT<"))
        absent(objects, "strategy_metric", {c: at(F.col("value"), f"metrics.{c}").isNull() for c in STRATEGY_METRICS}, F.col("model"), F.col("strategy"))
    return reduce(DataFrame.unionByName, problems)
