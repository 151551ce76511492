"""Nested documents: pruning, unnesting, and the audit of run documents rule by rule."""

import copy
import itertools
import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import sinks
from tidewatch.operators import audit, documents, profile

METRICS = {c: 0.5 for c in audit.REQUIRED_METRICS}


def whole():
    """A run without a problem; one ranking measure is null, which is allowed."""
    def model(name):
        return {"result": {"model": name, "backtest": {**METRICS, "roc_auc": None}, "forward": dict(METRICS)},
                "adaptation": {"strategies": [{"strategy": s, "metrics": dict(METRICS)} for s in audit.REQUIRED_STRATEGIES]}}
    return {
        "metadata": {"git_commit": "abc", "random_seed": 0, "feature_schema_hash": "h", "dataset": "d",
                     "package_versions": {p: "1" for p in audit.REQUIRED_PACKAGES},
                     "temporal_split": {**{f"{p}_period": ["a", "b"] for p in ("train", "validation", "backtest", "forward")}, "train_count": 5}},
        "metrics": {"models": [model(m) for m in audit.REQUIRED_MODELS], "drift_summary": {"n": 3}},
        "calibrations": {m: {p: {"brier": 0.1, "ece": 0.1} for p in ("backtest", "forward")} for m in audit.REQUIRED_MODELS},
        "drift_table": True}


def _cut(doc, *path):
    for key in path[:-1]:
        doc = doc[key]
    del doc[path[-1]]


def _put(value, doc, *path):
    for key in path[:-1]:
        doc = doc[key]
    doc[path[-1]] = value


BROKEN = {
    "whole": (lambda d: None, []),
    "unfinished": (lambda d: d.update(metrics=None), [("unfinished", "", None)]),
    "superseded": (lambda d: (_put({"reason": "old"}, d, "metadata", "superseded"), _cut(d, "metadata", "git_commit")), [("superseded", "", "old")]),
    "metadata": (lambda d: (_put("", d, "metadata", "dataset"), _put({}, d, "metadata", "package_versions")),
                 [("metadata", "dataset", None), ("metadata", "package_versions", None), *[("package_version", p, None) for p in audit.REQUIRED_PACKAGES]]),
    "split": (lambda d: (_cut(d, "metadata", "temporal_split", "train_count"), _put(None, d, "metadata", "temporal_split", "forward_period")),
              [("temporal_split", "train_count", None), ("temporal_split", "forward_period", None)]),
    "period": (lambda d: _cut(d, "metrics", "models", 0, "result", "forward"), [("period", "majority.forward", None)]),
    "metric": (lambda d: _cut(d, "metrics", "models", 0, "result", "backtest", "roc_auc"), [("metric", "majority.backtest.roc_auc", None)]),
    "deep": (lambda d: _put([1.0, {"x": [math.nan]}], d, "metrics", "models", 1, "result", "curve"),
             [("number", "logistic_regression.result.curve[1].x[0]", "NaN")]),
    "infinite": (lambda d: _put(-math.inf, d, "metrics", "models", 0, "result", "forward", "f1"), [("number", "majority.result.forward.f1", "-Infinity")]),
    "calibration": (lambda d: (_cut(d, "calibrations", "majority"), _put(None, d, "calibrations", "random_forest", "forward", "ece"),
                               _put(math.nan, d, "calibrations", "random_forest", "backtest", "brier")),
                    [("calibration", "majority", None), ("calibration_metric", "random_forest.forward.ece", None),
                     ("calibration_number", "random_forest.backtest.brier", "NaN")]),
    "drift": (lambda d: (_put({}, d, "metrics", "drift_summary"), d.update(drift_table=False)), [("drift_summary", "", None), ("drift_table", "", None)]),
    "strategies": (lambda d: (_cut(d, "metrics", "models", 0, "adaptation", "strategies", 2), _cut(d, "metrics", "models", 0, "adaptation", "strategies", 0, "metrics", "f1")),
                   [("required_strategy", "majority.recent_window_retrain", None), ("strategy_metric", "majority.none.f1", None)]),
    "models": (lambda d: _put([], d, "metrics", "models"), [("models", "", None), *[("required_model", m, None) for m in audit.REQUIRED_MODELS]]),
}


def test_audit_finds_exactly_what_is_broken(spark):
    runs, calibrations = [], []
    for name, (breaks, _) in BROKEN.items():
        doc = copy.deepcopy(whole())
        breaks(doc)
        runs.append((name, json.dumps(doc["metadata"]), None if doc["metrics"] is None else json.dumps(doc["metrics"]), doc["drift_table"]))
        calibrations += [(name, model, json.dumps(c)) for model, c in doc["calibrations"].items()]
    runs = spark.createDataFrame(runs, "run string, metadata string, metrics string, drift_table boolean").withColumns(
        {c: documents.parsed(F.col(c)) for c in ("metadata", "metrics")})
    calibrations = spark.createDataFrame(calibrations, "run string, model string, document string").withColumn("document", documents.parsed(F.col("document")))
    got = {name: [] for name in BROKEN}
    for r in documents.run_problems(runs, calibrations, strict=True).collect():
        got[r.run].append((r.check, r.item, r.value))
    assert {n: sorted(x, key=repr) for n, x in got.items()} == {n: sorted(x, key=repr) for n, (_, x) in BROKEN.items()}
    lenient = {(r.run, r.check) for r in documents.run_problems(runs, calibrations).collect()}
    assert not any(c.startswith(("required", "strategy")) for _, c in lenient) and ("models", "models") in lenient


def test_leaves_of_any_depth(spark):
    deep = {"x": 1}
    for _ in range(12):
        deep = {"d": [deep]}
    rows = [(1, json.dumps({"a": None, "b": {}, "c": [], "d": [True, "t", {"e": 1.5}]})), (2, json.dumps(deep)), (3, None), (4, "[3]"), (5, "{broken")]
    docs = spark.createDataFrame(rows, "id int, doc string").withColumn("v", documents.parsed(F.col("doc")))
    got = {(r.id, r.path): r.value for r in documents.leaves(docs, ["id"], "v").collect()}
    assert got == {(1, "a"): None, (1, "b"): "{}", (1, "c"): "[]", (1, "d[0]"): "true", (1, "d[1]"): "t", (1, "d[2].e"): "1.5",
                   (2, ".".join(["d[0]"] * 12) + ".x"): "1", (4, "[0]"): "3"}


def test_internal_names_go_at_any_depth(spark):
    df = spark.sql("""SELECT 1 AS a, 2 AS _b, 3 AS c_object, named_struct('x', 1, '_y', 2, 'in', array(named_struct('k', 1, 'm_object', 2))) AS s,
                      map('p', map(timestamp'2024-01-01 00:00:00', 1), '_q', map(timestamp'2024-01-01 00:00:00', 2)) AS m,
                      CAST(NULL AS STRUCT<x: INT, _y: INT>) AS none, named_struct('_only', 1) AS bare""")
    got = json.loads(sinks.public(df).toJSON().first())
    assert got == {"a": 1, "s": {"x": 1, "in": [{"k": 1}]}, "m": {"p": {"2024-01-01 00:00:00": 1}}, "bare": {}}


@pytest.mark.parametrize("clash", [False, True])
def test_duplicate_rows_by_digest(spark, monkeypatch, clash):
    rows = [(None, "a"), ("a", None), ("a", None), (None, None), ("b", "c"), ("b", "c"), ("b", "c")]
    df = spark.createDataFrame(rows, "x string, `y.z` string").withColumn("f", F.when(F.col("x") == "b", F.when(F.rand(1) < 2, -0.0)).otherwise(0.0))
    if clash:  # two digests of one bit: rows that differ share them, and the exact form has to step in
        digest, calls = F.xxhash64, itertools.count(1)
        monkeypatch.setattr(profile.F, "xxhash64", lambda *c: F.pmod(digest(*c), F.lit(2)) if next(calls) % 3 else digest(*c))
    got = profile.duplicate_rows(df).first()
    assert (got.row_count, got.duplicates) == (7, 3)
    none = profile.duplicate_rows(df.limit(0)).first()
    assert (none.row_count, none.duplicates) == (0, 0)


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, [1]), (-0.0, None, [1]), (0.0, None, None), (float("nan"), None, [2]), (float("nan"), None, [2])],
                               T.StructType([T.StructField("a.b", T.DoubleType()), T.StructField("none", T.StringType()), T.StructField("list", T.ArrayType(T.IntegerType()))]))
    got = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert (got["a.b"].distinct_values, got["a.b"].nulls, got["a.b"].data_type) == (3, 0, "double")
    assert (got["none"].distinct_values, got["none"].nulls, got["none"].all_null, got["none"].null_percent) == (0, 5, True, 100.0)
    assert (got["list"].distinct_values, got["list"].nulls, got["list"].data_type) == (2, 1, "array<int>")
    empty = profile.column_profile(df.limit(0)).collect()
    assert len(empty) == 3 and all(r.distinct_values == 0 and r.nulls == 0 and r.null_percent is None for r in empty)


def test_an_empty_drift_table_is_an_error(spark, tmp_path):
    events = spark.createDataFrame([("v", "ks", 0.5)], "feature string, method string, statistic double")
    assert spark.read.parquet(sinks.write_drift(events, str(tmp_path), "a")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_drift(events.limit(0), str(tmp_path), "b")
    assert not (tmp_path / "b").exists()
