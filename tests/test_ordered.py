"""Ordered primitives: plain windows and range slices must agree with NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators import running
from tidewatch.operators.running import cut_slices, last_seen, number_rows, reflected_sums, running_extreme, running_sums
from tidewatch.operators.sampling import random_rows, stratified_halves, take_smallest
from tidewatch.functions.hashing import digest
from tidewatch.session import ROWS_PER_SLICE_KEY


@pytest.fixture(params=["plain", "sliced", "levels"])
def slicing(request, spark, monkeypatch):
    """Plain windows, one level of slices, and slices that are cut again, with totals carried over blocks."""
    if request.param != "plain":
        spark.conf.set(ROWS_PER_SLICE_KEY, "300" if request.param == "sliced" else "40")
    if request.param == "levels":
        spark.conf.set(running.SLICES_PER_LEVEL_KEY, "2")
        monkeypatch.setattr(running, "FAN", 4)
        monkeypatch.setattr(running, "BLOCK", 4)
    yield request.param
    spark.conf.unset(ROWS_PER_SLICE_KEY)
    spark.conf.unset(running.SLICES_PER_LEVEL_KEY)


@pytest.fixture(scope="module")
def hot(spark):
    """2,000 rows, two groups, one value holding a third of all rows."""
    rng = np.random.default_rng(5)
    v = np.where(rng.random(2000) < 0.33, 7.0, np.round(rng.normal(0, 5, 2000), 3))
    pdf = pd.DataFrame({"id": np.arange(2000), "g": rng.choice(["a", "b"], 2000, p=[0.9, 0.1]), "v": v, "w": rng.normal(0, 1, 2000)})
    return pdf, spark.createDataFrame(pdf).cache()


def test_running_sums_and_totals(hot, slicing):
    pdf, df = hot
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"), F.sum("w").alias("s"))
    sliced, slices = cut_slices(counts, ["g", "v"], 2000)
    assert (slices is not None) == (slicing != "plain")
    got = running_sums(sliced, ["g"], ["v"], {"cn": "n", "cs": "s"}, {"t": "n"}, slices).toPandas()
    want = pdf.groupby(["g", "v"]).agg(n=("w", "size"), s=("w", "sum")).reset_index()
    want["cn"], want["cs"] = want.groupby("g").n.cumsum(), want.groupby("g").s.cumsum()
    want["t"] = want.groupby("g").n.transform("sum")
    merged = got.merge(want, on=["g", "v"], suffixes=("", "_w"))
    assert len(merged) == len(want)
    assert (merged.cn == merged.cn_w).all() and (merged.t == merged.t_w).all()
    assert np.allclose(merged.cs, merged.cs_w)


def test_running_extremes_and_last_seen(hot, slicing):
    pdf, df = hot
    sliced, slices = cut_slices(df, ["g", "id"], 2000)
    got = running_extreme(sliced, ["g"], ["id"], {"lo": "w"}, {"hi": "w"}, slices)
    mark = F.when(F.col("w") > 2, F.col("id"))
    got = last_seen(got, ["g"], ["id"], mark, "latest", slices)
    got = last_seen(got, ["g"], ["id"], mark, "earlier", slices, include_current=False).toPandas().sort_values("id")
    want = pdf.sort_values("id").copy()
    by = want.groupby("g")
    want["lo"], want["hi"] = by.w.cummin(), by.w.cummax()
    want["m"] = np.where(want.w > 2, want.id, np.nan)
    want["latest"] = want.groupby("g").m.ffill()
    want["earlier"] = want.groupby("g").latest.shift(1)
    for c in ("lo", "hi", "latest", "earlier"):
        assert np.array_equal(got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy(), equal_nan=True), c


def test_reflected_sums(hot, slicing):
    pdf, df = hot
    steps = df.withColumn("back", -F.col("w") - 0.3).withColumn("forth", F.col("w") - 0.3)
    sliced, slices = cut_slices(steps, ["g", "id"], 2000)
    got = reflected_sums(sliced, ["g"], ["id"], {"up": "forth", "down": "back"}, slices).toPandas().sort_values("id")
    for g, rows in got.groupby("g"):
        up = down = 0.0
        want = []
        for w in rows.w:
            up, down = max(0.0, up + w - 0.3), max(0.0, down - w - 0.3)
            want.append((up, down))
        assert np.allclose(rows[["up", "down"]], want, atol=1e-9), g
    assert [c for c in got.columns if c.startswith("_")] == ([slices] if slices else [])


def test_slices_beyond_one_level(hot, spark, monkeypatch):
    """64 slices from a range partitioner that makes 2: in order, equal keys together, none much too large."""
    _, df = hot
    spark.conf.set(ROWS_PER_SLICE_KEY, "32")
    spark.conf.set(running.SLICES_PER_LEVEL_KEY, "2")
    monkeypatch.setattr(running, "FAN", 8)
    try:
        got, slices = cut_slices(df, ["v", "id"], 2000)
        got = got.toPandas().sort_values(["v", "id"])
        ties, _ = cut_slices(df, ["v"], 2000)
        ties = ties.toPandas()
    finally:
        spark.conf.unset(ROWS_PER_SLICE_KEY)
        spark.conf.unset(running.SLICES_PER_LEVEL_KEY)
    assert len(got) == 2000 and got[slices].is_monotonic_increasing
    assert got[slices].nunique() > 40 and got[slices].value_counts().max() < 150
    assert (ties.groupby("v")[slices].nunique() == 1).all() and ties[slices].nunique() > 20
    assert ties.sort_values("v")[slices].is_monotonic_increasing


def test_row_numbers_with_a_hot_key(hot, slicing):
    pdf, df = hot
    got = number_rows(df, ["g"], ["v", "id"], "rn", 2000).toPandas().set_index("id").rn
    want = pdf.sort_values(["g", "v", "id"])
    want["rn"] = want.groupby("g").cumcount()
    assert (got.sort_index() == want.set_index("id").rn.sort_index()).all()


@pytest.mark.parametrize("probs", [[0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]])
def test_exact_quantiles(hot, slicing, probs):
    pdf, df = hot
    got = exact_quantiles(df, ["g"], "v", probs, 2000).toPandas()
    for r in got.itertuples():
        assert r.q == pytest.approx(np.quantile(pdf[pdf.g == r.g].v, r.p), abs=1e-12)
    assert len(got) == 2 * len(probs)


def test_smallest_hashes_are_exact(hot, spark):
    pdf, df = hot
    hashed = df.withColumn("h", digest(["id"], 3))
    quotas = spark.createDataFrame([("a", 700), ("b", 10_000)], "g string, quota long")
    got = take_smallest(hashed, ["g"], "h", quotas, ["id"]).toPandas()
    everything = hashed.toPandas().sort_values(["h", "id"])
    assert set(got[got.g == "a"].id) == set(everything[everything.g == "a"].id.head(700))
    assert len(got[got.g == "b"]) == (pdf.g == "b").sum()


def test_samples_do_not_depend_on_partitioning(hot):
    _, df = hot
    a = {r.id for r in random_rows(df, 321, ["id"]).select("id").collect()}
    b = {r.id for r in random_rows(df.repartition(7), 321, ["id"]).select("id").collect()}
    assert a == b and len(a) == 321
    arms = stratified_halves(df.withColumn("y", (F.col("v") == 7.0).cast("int")), "y", ["id"]).toPandas()
    share = arms.groupby("arm").y.mean()
    assert len(arms) == 2000 and abs(share["train"] - share["rest"]) < 0.01
