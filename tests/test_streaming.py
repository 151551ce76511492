import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_drift import sequential_loop
from tidewatch.operators.preprocess import fit_features
from tidewatch.plans.models import fit_model
from tidewatch.streaming import monitor, serving
from tidewatch.streaming.sequential import cusum_stream


def write_parts(pdf, folder, parts, order):
    folder.mkdir()
    for i, j in enumerate(order):
        pdf.iloc[j::parts].to_parquet(folder / f"part-{i:02d}.parquet", coerce_timestamps="us")


def read(spark, folder, files):
    schema = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(folder))


@pytest.mark.parametrize("files", [1, 4])
def test_stateful_cusum_does_not_depend_on_batches(spark, tmp_path, files):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(1.5, 1, 150)])
    pdf = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=300, freq="s"), "v": x})
    # Four files with interleaved rows: every batch brings rows older than ones already seen.
    write_parts(pdf, tmp_path / "in", 4, [2, 0, 3, 1])
    flow = cusum_stream(read(spark, tmp_path / "in", files), ["v"], threshold=4.0, warmup=40, delay="10 minutes")
    # With one file per batch the rest stays behind the watermark, so close the stream by a late marker.
    pd.DataFrame({"timestamp": [pd.Timestamp("2024-01-02")], "v": [0.0]}).to_parquet(tmp_path / "in" / "part-99.parquet", coerce_timestamps="us")
    monitor.run_to_end(flow, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("n_window").toPandas().head(300)
    want = sequential_loop(x, 4.0, 40)
    assert len(got) == 300 and np.allclose(got.statistic, [w[0] for w in want], atol=1e-9)
    assert got.alert.tolist() == [w[1] for w in want] and got.alert.sum() > 3


@pytest.fixture
def arrivals(spark, tmp_path):
    """Training rows, and three later files of 100 rows whose classes move apart."""
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    pdf = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=400, freq="min"), "label": y,
                        "a": y + rng.normal(0, .5, 400) + np.repeat([0, 1, 2, 3], 100) * 0.5})
    for i in range(3):
        pdf[100 * (i + 1):100 * (i + 2)].to_parquet(_folder(tmp_path / "in") / f"part-{i}.parquet", coerce_timestamps="us")
        time.sleep(0.02)
    return spark.createDataFrame(pdf.head(100)), tmp_path / "in"


def _folder(path):
    path.mkdir(exist_ok=True)
    return path


def _refit(spark, root, train, kind=serving.RollingRefit, **settings):
    fitted = fit_features(train, ["a"])
    return kind(lambda rows: fit_model("logistic_regression", rows, fitted), train, serving.ModelRegistry(spark, f"{root}/registry"),
                f"{root}/history", f"{root}/scored", **settings)


def _stream(spark, folder):
    return read(spark, folder, 1).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _scores(spark, root):
    return spark.read.parquet(f"{root}/scored").orderBy("timestamp").select("batch_id", "model_version", "y_score").toPandas()


def test_rolling_refit_scores_before_it_learns(spark, arrivals, tmp_path):
    train, folder = arrivals
    step = _refit(spark, tmp_path / "r", train, window_seconds=3600)
    serving.run_refit(_stream(spark, folder), step, str(tmp_path / "r" / "p"))
    got = _scores(spark, tmp_path / "r")
    assert len(got) == 300 and (got.model_version == got.batch_id).all()
    versions = step.registry.versions().orderBy("version").collect()
    # 100 training rows, and up to 61 rows of the last hour once a batch has been seen.
    assert [v.version for v in versions] == [0, 1, 2, 3] and [v.rows for v in versions] == [100, 161, 161, 161]
    batch = step.registry.load(1)
    rows = spark.read.parquet(str(folder / "part-1.parquet"))
    want = batch.model.score(rows).orderBy("timestamp").toPandas().y_score
    assert np.allclose(got[got.batch_id == 1].y_score, want)


class _Dies(serving.RollingRefit):
    """Ends in the middle of its second batch: scores and history are written, the version is or is not."""

    def __call__(self, batch, batch_id):
        if batch_id == 1 and not self.publishes:
            self.registry = type("Broken", (), {"latest": self.registry.latest, "load": self.registry.load, "publish": lambda *a: 1 / 0})()
        super().__call__(batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("the driver is gone")


@pytest.mark.parametrize("publishes", [False, True])
def test_refit_goes_on_after_a_crash(spark, arrivals, tmp_path, publishes):
    train, folder = arrivals
    serving.run_refit(_stream(spark, folder), _refit(spark, tmp_path / "whole", train), str(tmp_path / "whole" / "p"))
    dies = _refit(spark, tmp_path / "cut", train, _Dies)
    dies.publishes = publishes
    with pytest.raises(Exception):
        serving.run_refit(_stream(spark, folder), dies, str(tmp_path / "cut" / "p"))
    # A new object has only the files; its training rows are the same table.
    serving.run_refit(_stream(spark, folder), _refit(spark, tmp_path / "cut", train), str(tmp_path / "cut" / "p"))
    whole, cut = _scores(spark, tmp_path / "whole"), _scores(spark, tmp_path / "cut")
    assert len(cut) == 300 and (whole[["batch_id", "model_version"]] == cut[["batch_id", "model_version"]]).all(axis=None)
    assert np.allclose(whole.y_score, cut.y_score, atol=1e-9)


def test_stream_keeps_its_model_version(spark, arrivals, tmp_path):
    train, folder = arrivals
    registry, fitted = serving.ModelRegistry(spark, str(tmp_path / "registry")), fit_features(train, ["a"])
    with pytest.raises(KeyError):
        registry.pinned(str(tmp_path / "p"))
    registry.publish(0, fit_model("logistic_regression", train, fitted), 0.5)
    assert registry.pinned(str(tmp_path / "p")).number == 0
    registry.publish(1, fit_model("majority", train, fitted), 0.5)
    assert registry.pinned(str(tmp_path / "p")).number == 0 and registry.pinned(str(tmp_path / "other")).number == 1
    assert registry.load(1).model.score(train).select("y_score").distinct().count() == 1
    with pytest.raises(KeyError):
        registry.load(7)
    scored = serving.score_stream(_stream(spark, folder), registry.pinned(str(tmp_path / "p")))
    monitor.run_to_end(scored, str(tmp_path / "out"), str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("timestamp").toPandas()
    want = registry.load(0).model.score(spark.read.parquet(str(folder))).orderBy("timestamp").toPandas()
    assert np.allclose(got.y_score, want.y_score) and (got.y_pred == (want.y_score >= 0.5)).all() and (got.model_version == 0).all()


@pytest.mark.parametrize("offset", [0.0, 1e12])
@pytest.mark.parametrize("files", [1, 4])
def test_mean_shift_far_from_zero(spark, tmp_path, offset, files):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 3, 600) + np.repeat([0, 0, 2], 200), 3)
    pdf = pd.DataFrame({"timestamp": pd.date_range("2023-12-31 23:40", periods=600, freq="min"), "v": x + offset})
    pdf.loc[5, "v"] = np.nan
    write_parts(pdf[200:], tmp_path / "in", 4, [2, 0, 3, 1])
    pd.DataFrame({"timestamp": [pd.Timestamp("2024-02-01")], "v": [0.0]}).to_parquet(tmp_path / "in" / "part-99.parquet", coerce_timestamps="us")
    moments = monitor.reference_moments(spark.createDataFrame(pdf[:200]), ["v"])
    got = monitor.mean_shift(read(spark, tmp_path / "in", files), moments, "100 minutes", delay="1 day", min_samples=100)
    monitor.run_to_end(got, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").toPandas()
    ref = (pdf.v[:200] - offset).dropna()
    parts = (pdf.v[200:] - offset).to_numpy().reshape(4, 100)
    assert (got.n_window == 100).all() and (got.n_reference == 199).all()
    assert np.allclose(got.effect_size, np.abs(parts.mean(axis=1) - ref.mean()) / ref.std(ddof=0), rtol=1e-9)
    assert np.allclose(got.spread, parts.std(axis=1) / ref.std(ddof=0), rtol=1e-9) and got.alert.tolist() == [False, False, True, True]
