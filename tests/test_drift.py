"""Detectors against brute force, on plain windows and on range slices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.stats import kolmogorov_quantile, ks_critical, ks_p_value
from tidewatch.operators import cusum, drift, windows
from tidewatch.operators import sequential as sq
from tidewatch.session import FREE_SHUFFLES_KEY, ROWS_PER_SLICE_KEY
from tidewatch.operators.sequential import sequential_cusum

HOUR = windows.HOUR
FEATURES = ("flow_duration", "total_bytes")


def ks_w1_psi(ref, win):
    v = np.sort(np.concatenate([ref, win]))
    fr = np.searchsorted(np.sort(ref), v, "right") / len(ref)
    fw = np.searchsorted(np.sort(win), v, "right") / len(win)
    gap = np.abs(fr - fw)
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    p = np.clip(np.histogram(ref, edges)[0] / len(ref), 1e-6, None)
    q = np.clip(np.histogram(win, edges)[0] / len(win), 1e-6, None)
    return gap.max(), (gap[:-1] * np.diff(v)).sum(), ((q - p) * np.log(q / p)).sum()


def cusum_loop(ref, win, block, limit, drift_=0.5, warmup=20):
    x = win[: len(win) // block * block].reshape(-1, block).mean(1) if len(win) >= 2 * block else win
    pos = neg = peak = 0.0
    first = None
    for i, z in enumerate((x - ref.mean()) / ref.std()):
        if i >= warmup:
            pos, neg = max(0.0, pos + z - drift_), max(0.0, neg - z - drift_)
            peak = max(peak, pos, neg)
            if first is None and peak > limit:
                first = i
    return peak, first


def frames(spark, shift=1.5):
    rng = np.random.default_rng(0)
    ref = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=1500, freq="min"), "id": np.arange(1500),
                        "flow_duration": np.round(rng.exponential(3, 1500), 1), "total_bytes": rng.normal(5, 2, 1500)})
    tgt = pd.DataFrame({"timestamp": pd.date_range("2024-02-01", periods=900, freq="min").repeat(2)[:900], "id": np.arange(900),
                        "flow_duration": np.round(rng.exponential(3 * shift, 900), 1), "total_bytes": rng.normal(5 + shift, 2, 900)})
    tgt.loc[::3, "flow_duration"] = 2.0

    def load(pdf):
        return spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return ref, tgt, load(ref), load(tgt)


@pytest.mark.parametrize("stride", [3, 2])
def test_detectors_match_brute_force(spark, slicing, stride):
    ref, tgt, R, T = frames(spark)
    settings = drift.DriftSettings(window=3 * HOUR, stride=stride * HOUR, min_samples=100, methods=drift.METHODS,
                                   cusum_threshold=5.0, cusum_block=4, tiebreak=("id",), features=FEATURES)
    got = drift.drift_events(R, T, settings).toPandas()
    starts = sorted(got.window_start.unique())
    assert len(starts) >= 2 and len(got) == len(starts) * 2 * 4
    for start in starts:
        win = tgt[(tgt.timestamp >= start) & (tgt.timestamp < start + pd.Timedelta(hours=3))]
        assert len(win) >= 100
        for f in FEATURES:
            row = got[(got.window_start == start) & (got.feature == f)].set_index("method")
            want = (*ks_w1_psi(ref[f].to_numpy(), win[f].to_numpy()),
                    cusum_loop(ref[f].to_numpy(), win[f].to_numpy(), 4, 5.0)[0])
            for method, value in zip(drift.METHODS, want):
                assert row.statistic[method] == pytest.approx(value, abs=1.1e-6), (f, method)
            iqr = np.subtract(*np.percentile(ref[f], [75, 25]))
            assert row.effect_size["wasserstein"] == pytest.approx(want[1] / iqr, abs=1.1e-6)
            assert row.n_window["ks"] == len(win) and row.n_reference["ks"] == len(ref)
            assert row.alert["cusum"] == (cusum_loop(ref[f].to_numpy(), win[f].to_numpy(), 4, 5.0)[1] is not None)


def test_shifted_data_alerts_and_same_data_is_quiet(spark):
    _, _, R, T = frames(spark, shift=3.0)
    # The last window of the quiet run would hold 60 rows, too few for a stable PSI.
    settings = drift.DriftSettings(window=24 * HOUR, min_samples=100, features=FEATURES, methods=("ks", "wasserstein", "psi"))
    assert drift.drift_events(R, T, settings).where("alert").count() == 6
    quiet = drift.drift_events(R, R, settings).where("alert").count()
    assert quiet == 0


def test_constant_reference_and_null_values(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,id) AS timestamp, 4.0 AS a, IF(id % 2 = 0, NULL, double(id)) AS b FROM range(400)")
    got = drift.drift_events(df, df, drift.DriftSettings(window=HOUR * 100, min_samples=10, features=("a", "b"))).toPandas()
    a, b = got[got.feature == "a"], got[got.feature == "b"]
    assert (a.statistic == 0).all() and not a.alert.any()
    assert (b.n_window == 399).all() and (b.n_reference == 400).all()  # rows of the samples, gaps included


def test_small_windows_and_bad_settings(spark):
    _, _, R, T = frames(spark)
    base = dict(features=FEATURES, methods=("psi",))
    none = drift.drift_events(R, T, drift.DriftSettings(window=HOUR, min_samples=10_000, **base))
    with pytest.raises(ValueError, match="no rows"):
        drift.require_events(none)
    with pytest.raises(ValueError, match="positive"):
        drift.drift_events(R, T, drift.DriftSettings(window=0, **base))
    with pytest.raises(KeyError):
        drift.drift_events(R, T, drift.DriftSettings(features=("nope",)))
    assert drift.drift_events(R, T.where("false"), drift.DriftSettings(**base)).count() == 0
    long = drift.drift_events(R, T, drift.DriftSettings(window=10_000 * HOUR, min_samples=100, **base))
    assert long.count() >= 2
    tiny = drift.drift_events(R.limit(50), T, drift.DriftSettings(window=3 * HOUR, min_samples=100, **base)).toPandas()
    assert len(tiny) and not tiny.alert.any() and tiny.threshold.isna().all()


def test_method_names():
    assert drift.known_methods(["ks", "psi", "ks"]) == ["ks", "psi"]
    for bad in ["KS"], [3], []:
        with pytest.raises(ValueError):
            drift.known_methods(bad)


def test_features_without_values_keep_their_rows(spark, slicing):
    df = spark.sql("""SELECT timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,id) AS timestamp, double(id % 17) AS a,
        CAST(NULL AS DOUBLE) AS b, IF(id = 3, 7.0D, NULL) AS c FROM range(400)""")
    methods = ("ks", "wasserstein", "psi")
    got = drift.drift_events(df, df, drift.DriftSettings(window=HOUR, min_samples=10, features=("a", "b", "c"), methods=methods)).toPandas()
    assert len(got) == 7 * 9 and set(got.n_window) == {60, 40} and (got.n_reference == 400).all()
    empty = got[got.feature.isin(["b", "c"])]
    assert (empty.statistic == 0).all() and not empty.alert.any() and (empty.effect_size == 0).all() and empty.p_value.isna().all()


def test_large_offsets_keep_their_digits(spark):
    rng = np.random.default_rng(5)
    ref, win = rng.normal(0, 10, 20_000), rng.normal(0.3, 10, 1_999)
    results = []
    for offset in (0.0, 1e12):
        r, w = np.round(ref + offset, 3), np.round(win + offset, 3)
        frame = lambda x: pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=len(x), freq="s"), "a": x})
        R, T = spark.createDataFrame(frame(r)), spark.createDataFrame(frame(w))
        got = drift.drift_events(R, T, drift.DriftSettings(window=HOUR, min_samples=10, features=("a",), methods=("wasserstein",))).toPandas()
        w = w[:got.n_window[0]]  # a single window ends before the last row
        xs = np.sort(np.concatenate([r, w])) - offset
        gaps = np.abs(np.searchsorted(np.sort(r - offset), xs[:-1], "right") / len(r) - np.searchsorted(np.sort(w - offset), xs[:-1], "right") / len(w))
        results.append((got.statistic[0], float((gaps * np.diff(xs)).sum())))
    for have, want in results:
        assert have == pytest.approx(want, rel=2e-3)


def test_sample_sizes_of_billions(spark):
    counts = spark.sql("SELECT 4000000000 AS finite_reference, 4000000000 AS finite_window")
    assert counts.select(drift.effective_size().alias("n")).first().n == 2e9


def test_ks_formulas(spark):
    row = spark.range(1).select(
        ks_critical(0.01, F.lit(1270025.0 * 101398 / (1270025 + 101398))).alias("a"),
        ks_critical(0.01, F.lit(4409934.0 * 269693 / (4409934 + 269693))).alias("b"),
        ks_p_value(ks_critical(0.05, F.lit(400.0)), F.lit(400.0)).alias("p"), ks_p_value(F.lit(0.0), F.lit(50.0)).alias("one")).first()
    assert round(row.a, 6) == 0.00531 and round(row.b, 6) == 0.003228
    assert row.p == pytest.approx(0.05, abs=1e-9) and row.one == 1.0
    assert kolmogorov_quantile(0.05) == pytest.approx(1.3580986, abs=1e-6)


def test_null_thresholds_match_the_loop(spark):
    got = {r.n_sequence: r.threshold for r in cusum.null_thresholds(
        spark.createDataFrame([(60,), (120,), (120,)], "n_sequence long"), trials=40).collect()}
    for length, value in got.items():
        rng, peaks = np.random.default_rng(0), []
        for _ in range(40):
            pos = neg = peak = 0.0
            for z in rng.normal(0, 1, length)[20:]:
                pos, neg = max(0.0, pos + z - 0.5), max(0.0, neg - z - 0.5)
                peak = max(peak, pos, neg)
            peaks.append(peak)
        assert value == pytest.approx(np.quantile(peaks, 0.99), abs=1e-9)
    assert got[120] >= got[60] and set(got) == {60, 120}


def test_calibrated_cusum_is_quiet_on_the_same_data(spark):
    _, _, R, _ = frames(spark)
    settings = drift.DriftSettings(window=5 * HOUR, min_samples=50, methods=["cusum"], cusum_block=5, features=FEATURES)
    assert drift.drift_events(R, R, settings).where("alert").count() <= 1


def test_sweep_covers_all_settings(spark):
    _, _, R, T = frames(spark)
    got = drift.sweep(R, T, drift.DriftSettings(window=5 * HOUR, min_samples=50, cusum_block=5, features=FEATURES)).toPandas()
    assert set(got.variant) == {g[0] for g in drift.SWEEP}
    rate = got.set_index("variant").alert_rate
    assert rate["ks_alpha_0.001"] <= rate["ks_alpha_0.05"] and rate["psi_0.50"] <= rate["psi_0.10"]


def sequential_loop(x, threshold, warmup, drift_=0.5):
    seen, out, pos, neg = [], [], 0.0, 0.0
    for value in x:
        if not np.isfinite(value):
            out.append((0.0, False))
        elif len(seen) < warmup:
            seen.append(value)
            out.append((0.0, False))
        else:
            z = (value - np.mean(seen)) / (np.std(seen) or 1.0)
            pos, neg = max(0.0, pos + z - drift_), max(0.0, neg - z - drift_)
            stat = max(pos, neg)
            alarm = stat > threshold
            if alarm:
                pos = neg = 0.0
            out.append((stat, alarm))
    return out


def test_sequential_detector(spark, slicing):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 700), rng.normal(0.8, 1, 600)])
    x[[3, 500]] = np.nan
    pdf = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=1300, freq="s").repeat(2)[:1300], "id": np.arange(1300), "v": x})
    df = spark.createDataFrame(pdf).repartition(5)
    got = sequential_cusum(df, ["v"], ["id"], threshold=4.0, warmup=50).toPandas().sort_values("id")
    want = sequential_loop(x, 4.0, 50)
    assert np.allclose(got.statistic, [w[0] for w in want], atol=1e-9)
    assert got.alert.tolist() == [w[1] for w in want] and sum(got.alert) > 5
    assert got.n_window.tolist() == list(range(1, 1301))


def test_transfers_give_the_end_of_any_start():
    rng = np.random.default_rng(0)
    for trial in range(1500):
        threshold, step = rng.choice([0.5, 2.0, 5.0]), rng.choice([0.0, 0.2, 0.5])
        z = rng.normal(rng.choice([-1, 0, 1.0]), rng.choice([.1, 1, 3]), rng.integers(0, 60))
        z = np.round(z) if trial % 7 == 0 else z
        pos, neg = rng.random(2) * threshold * rng.choice([0, 1], 2)
        want = sq.walk(z, np.ones(len(z), bool), pos, neg, threshold, step)[2:]
        assert np.allclose(sq.apply_transfer(sq.transfer(z, threshold, step), pos, neg, threshold), want, atol=1e-9)


@pytest.mark.parametrize("drift_", [0.0, 0.5])
def test_every_slice_starts_away_from_zero(spark, drift_):
    """Small steady steps: a sum grows over many slices, so no slice starts in the state (0, 0) that one would guess."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 60), np.full(1940, 0.51 if drift_ else 0.01) + rng.normal(0, 1e-4, 1940)])
    df = spark.createDataFrame(pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=2000, freq="s"), "id": np.arange(2000), "v": x}))
    spark.conf.set(ROWS_PER_SLICE_KEY, "40")
    try:
        got = sequential_cusum(df, ["v"], ["id"], threshold=6.0, drift=drift_, warmup=50).toPandas().sort_values("id")
        starts = got[(got.n_window > 61) & (got.n_window % 40 == 0)].statistic
    finally:
        spark.conf.unset(ROWS_PER_SLICE_KEY)
    want = sequential_loop(x, 6.0, 50, drift_)
    assert np.allclose(got.statistic, [w[0] for w in want], atol=1e-9) and got.alert.tolist() == [w[1] for w in want]
    assert (starts > 0).all() and len(starts) > 40


def test_second_rounding_is_that_of_the_sql(spark):
    import duckdb
    from tidewatch.functions.columns import round_scaled

    values = [i / 1e6 for i in range(5, 200_000, 10)] + [-0.020085, 0.0]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(round_scaled(F.col("v"), 5).alias("v")).collect()]
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"v": values}))
    assert got == [r[0] for r in con.execute("SELECT round(v, 5) FROM t").fetchall()]
    assert got[values.index(0.020085)] == 0.02008


def test_python_holds_short_slices_only(spark, monkeypatch):
    x = np.random.default_rng(8).normal(0, 1, 900)
    df = spark.createDataFrame(pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=900, freq="s"), "id": np.arange(900), "v": x}))
    sizes, made = [], sq.transfers
    monkeypatch.setattr(sq, "PART_ROWS", 100)
    monkeypatch.setattr(sq, "transfers", lambda placed, *a: sizes.append([r[0] for r in placed.groupBy("feature", "part").count().select("count").collect()]) or made(placed, *a))
    got = sequential_cusum(df, ["v"], ["id"], threshold=4.0, warmup=50).toPandas().sort_values("id")
    assert sizes == [[100] * 9]
    want = sequential_loop(x, 4.0, 50)
    assert np.allclose(got.statistic, [w[0] for w in want], atol=1e-9) and got.alert.tolist() == [w[1] for w in want]


def test_large_inputs_are_counted_a_few_features_at_a_time_and_leave_no_shuffles(spark, monkeypatch):
    _, _, R, T = frames(spark)
    settings = drift.DriftSettings(window=3 * HOUR, min_samples=100, methods=drift.METHODS, cusum_threshold=5.0,
                                   cusum_block=4, tiebreak=("id",), features=(*FEATURES, "twice"))

    def derive(df):
        return df.withColumn("twice", F.col("total_bytes") * 2)
    want = drift.drift_events(derive(R), derive(T), settings).toPandas()
    counted, once = [], []
    monkeypatch.setattr(drift, "VALUES_PER_BATCH", 2400)
    monkeypatch.setattr(drift.ts2, "pooled_counts", lambda r, w, names, f=drift.ts2.pooled_counts: counted.append(list(names)) or f(r, w, names))
    for module in (drift, cusum):
        monkeypatch.setattr(module, "run_once", lambda df, f=module.run_once: once.append(f(df)) or once[-1])
    spark.conf.set(ROWS_PER_SLICE_KEY, "2000")
    try:
        got = drift.drift_events(R, T, settings, derive).toPandas()
    finally:
        spark.conf.unset(ROWS_PER_SLICE_KEY)
    assert counted == [["flow_duration"], ["total_bytes"], ["twice"]]
    assert len(once) >= 2 * len(counted)
    assert all(df._jdf.queryExecution().shuffleCleanupMode().toString() == "RemoveShuffleFiles" for df in once)
    assert spark.conf.get(FREE_SHUFFLES_KEY) == "false"
    key = ["window_start", "feature", "method"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))


def test_features_that_follow_from_others_are_not_shuffled(spark):
    rows = spark.range(900).select(F.lit(0).alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"), "id",
                                   F.sin(F.col("id") * 1.0).alias("a"))

    def derive(df):
        return df.withColumns({f"f{i}": F.col("a") * i for i in range(1, 9)})
    names = [f"f{i}" for i in range(1, 9)]
    spark.conf.set(ROWS_PER_SLICE_KEY, "899")
    try:
        late = cusum.sequence_means(rows, names, ["id"], 4, 898, derive=derive)
        plain = cusum.sequence_means(derive(rows), names, ["id"], 4, 898)
    finally:
        spark.conf.unset(ROWS_PER_SLICE_KEY)
    first = [p._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1].splitlines()[1:] for p in (late, plain)]
    assert not any("f8" in line for line in first[0]) and any("f8" in line for line in first[1])
    a, b = (sorted(map(tuple, p.select("k", "feature", "step", "x").collect())) for p in (late, plain))
    assert a == b and len(a) == 8 * 225
