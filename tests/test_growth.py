"""Steps whose work must not grow faster than their input."""

import threading
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import audit, cusum, failure, running
from tidewatch.plans import adaptation, experiment, static_eval
from tidewatch.session import ROWS_PER_SLICE_KEY


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_policy_reports_do_not_multiply_parts_by_suppliers(spark, tmp_path):
    spark.range(2000).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size", "CAST(id % 7 AS STRING) AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(500).selectExpr("CAST(id % 25 AS INT) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    out = entry.queries()["feature_policy"](spark, str(tmp_path))
    assert "Join LeftSemi" in plan_of(out) and "Join Inner" not in plan_of(out)
    assert out.count() == 25


def test_asof_looks_up_each_time_once(spark, monkeypatch):
    left = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 > 0, F.col("id") % 20).alias("t"))
    right = spark.range(60).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 3).alias("u"), F.col("id").alias("v")).dropDuplicates(["g", "u"])
    seen = []
    cut = failure.cut_slices
    monkeypatch.setattr(failure, "cut_slices", lambda df, order, rows: seen.append((df.count(), rows)) or cut(df, order, rows))
    spark.conf.set(ROWS_PER_SLICE_KEY, "100")
    try:
        got = failure.asof(left, right, "t", "u", ["v"], by=["g"], expected_rows=3100).toPandas()
    finally:
        spark.conf.unset(ROWS_PER_SLICE_KEY)
    times = left.select("g", "t").distinct().count()
    assert seen == [(times + right.count(),) * 2]
    r = right.toPandas()
    assert len(got) == 3000 and got.id.nunique() == 3000
    for row in got.itertuples():
        some = r[(r.g == row.g) & (r.u <= row.t)] if row.t == row.t else r[:0]
        want = some.v[some.u.idxmax()] if len(some) else None
        assert (want is None and np.isnan(row.v)) or want == row.v


def test_requested_models_are_made_distinct_before_they_are_joined(spark):
    asked = spark.range(1000).select(F.element_at(F.array(F.lit("majority"), F.lit("neural_network")), (F.col("id") % 2 + 1).cast("int")).alias("model"))
    out = audit.requested_models(asked)
    right = plan_of(out).split("Join LeftSemi")[1]
    assert any(line.lstrip().startswith("+- Aggregate") for line in right.splitlines())
    assert sorted(map(tuple, out.collect())) == [("majority", 0), ("neural_network", 4)]


def test_rows_are_numbered_in_buckets_without_storing_them(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(3000), "g": rng.choice(["a", "b"], 3000), "t": np.where(rng.random(3000) < 0.1, 500, rng.integers(0, 900, 3000))})
    pdf["n"] = pdf.sort_values(["t", "id"]).groupby("g").cumcount()
    df = spark.createDataFrame(pdf.drop(columns="n"))
    stored = []
    monkeypatch.setattr(running, "materialize", lambda x, f=running.materialize: stored.append(1) or f(x))
    for buckets, limit, hot in ((16_384, 400, False), (7, 400, False), (16_384, 100, True)):
        monkeypatch.setattr(running, "BUCKETS", buckets)
        spark.conf.set(ROWS_PER_SLICE_KEY, str(limit))
        try:
            got = running.number_rows(df, ["g"], ["t", "id"], "n", 3000, size="size", place=F.col("t")).toPandas().sort_values("id")
        finally:
            spark.conf.unset(ROWS_PER_SLICE_KEY)
        assert (got.n.to_numpy() == pdf.n.to_numpy()).all() and bool(stored) == hot
        assert (got["size"].to_numpy() == pdf.groupby("g").id.transform("size").to_numpy()).all()
        assert list(got.columns) == ["id", "g", "t", "n", "size"] or hot
    late = df.withColumn("t", F.when(F.col("id") > 5, F.col("t")))
    assert running._number_in_buckets(late, ["g"], ["t", "id"], "n", F.col("t"), 4000, None) is None


def test_cusum_of_sequences_that_fit_a_task_reads_them_once(spark):
    sequence = spark.range(400).select((F.col("id") % 2).alias("k"), F.lit("f").alias("feature"), F.floor(F.col("id") / 2).alias("step"),
                                       F.sin(F.col("id") * 1.7).alias("x"))
    moments = spark.createDataFrame([("f", 0.1, 0.8)], "feature string, mu double, sigma double")
    paths = {n: cusum.cusum_path(sequence, moments, 0.1, 5, n) for n in (200, None)}
    reads = {n: plan_of(p).count("Range (0, 400") for n, p in paths.items()}
    assert reads[200] == 1 and reads[None] > 1
    a, b = (p.toPandas().sort_values(["k", "step"]).cusum.to_numpy() for p in paths.values())
    assert len(a) == 390 and np.allclose(a, b, atol=1e-12)
    windows = spark.range(1050).select((F.col("id") >= 1000).cast("long").alias("k"))
    assert cusum.longest_sequence(windows, 10) == 100 and cusum.longest_sequence(windows, 600) == 1000
    assert cusum.longest_sequence(windows.limit(0), 10) == 0


def test_scores_are_made_once_for_all_metrics(spark):
    made = spark.sparkContext.accumulator(0)

    def score(i):
        made.add(1)
        return (i * 37 % 100) / 100.0
    rows = spark.range(400).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"), (F.col("id") % 3 == 0).cast("int").alias("y_true"),
                                   F.udf(score, "double")("id").alias("y_score"))
    found = experiment.evaluate(rows, 0.5)
    assert found["row_count"] == 400 and 0 < found["roc_auc"] < 1
    assert made.value == 400


def test_independent_fits_run_at_once_and_never_more_than_a_few(spark):
    lock, now, most = threading.Lock(), [0], [0]

    def fit(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2)
        with lock:
            now[0] -= 1
        return i

    def sweep(i):
        return experiment.at_once(spark, [lambda k=k: fit((i, k)) for k in range(3)])
    got = experiment.at_once(spark, [lambda i=i: sweep(i) for i in range(6)])
    assert got == [[(i, k) for k in range(3)] for i in range(6)]
    assert 1 < most[0] <= experiment.PARALLEL


def test_the_strategies_of_a_study_and_the_models_of_a_grid_run_at_once(spark, monkeypatch):
    seen = []
    for module in (adaptation, static_eval):
        monkeypatch.setattr(module, "at_once", lambda s, tasks, f=experiment.at_once: seen.append(len(tasks)) or f(s, tasks))
    rows = spark.range(300).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    out = static_eval.evaluate_grid(rows, rows, ["majority", "logistic_regression"], {"X": ["a"]}, {"logistic_regression": {"max_iter": 3}})
    assert [(r.feature_set, r.model) for r in out.collect()] == [("X", "majority"), ("X", "logistic_regression")]
    entry.queries()["adaptation_study"](spark, "/root/testdata/sf0.001")
    assert seen == [1, 2, len(adaptation.STRATEGIES)]
