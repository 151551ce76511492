"""The temporal benchmark: fit on the past, fix a threshold, score later periods."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import metrics
from tidewatch.operators.combine import with_row
from tidewatch.operators.preprocess import FittedFeatures, fit_features
from tidewatch.operators.split import TimeCuts, find_cuts
from tidewatch.plans.models import FittedModel, fit_model
from tidewatch.schema import LABEL, TIME

METRIC_SCHEMA = ("precision double, recall double, f1 double, false_positive_rate double, false_negative_rate double, "
                 "balanced_accuracy double, true_positives long, false_positives long, true_negatives long, "
                 "false_negatives long, row_count long, attacks long, roc_auc double, pr_auc double")
METRIC_NAMES = [part.split()[0] for part in METRIC_SCHEMA.split(", ")]


# Fits that run at a time: the jobs of one fit are short and leave most cores idle.
PARALLEL = 4


_inside = threading.local()


def at_once(spark: SparkSession, tasks: Sequence[Callable[[], object]]) -> list:
    """The results of independent tasks in their order, ``PARALLEL`` of them at a time; tasks inside tasks run one by one."""
    if getattr(_inside, "pool", False):
        return [task() for task in tasks]

    def run(task):
        _inside.pool = True
        return task()

    with ThreadPoolExecutor(PARALLEL) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), task) for task in tasks]]


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept while it is read several times, so that its rows are scored once."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


@dataclass(frozen=True)
class Bench:
    """A dataset with its periods and the features learnt from the training period."""

    data: DataFrame
    cuts: TimeCuts
    features: FittedFeatures
    params: dict
    seed: int = 42
    budget: float = 0.05

    def period(self, name: str) -> DataFrame:
        return self.cuts.period(self.data, name)

    def fit(self, model: str, rows: DataFrame | None = None, features: FittedFeatures | None = None) -> FittedModel:
        train = self.period("train") if rows is None else rows
        return fit_model(model, train, features or self.features, self.params.get(model), self.seed)


def prepare(data: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
            params: dict | None = None, seed: int = 42, budget: float = 0.05, cuts: TimeCuts | None = None) -> Bench:
    """Split the time axis and fit the feature preparation on the training period only."""
    cuts = cuts or find_cuts(data)
    numeric = schema.flow_features(data, "number") if numeric is None else numeric
    categorical = schema.flow_features(data, "name") if categorical is None else categorical
    fitted = fit_features(cuts.period(data, "train"), numeric, categorical, cutoff=cuts.bounds("train")[1])
    return Bench(data, cuts, fitted, params or {}, seed, budget)


def score_table(model: FittedModel, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return model.score(rows).select(*keep, TIME, F.col(LABEL).alias("y_true"), "y_score")


def metric_rows(scored: DataFrame, by: list[str], expected_rows: int | None = None) -> DataFrame:
    """Confusion metrics and ranking areas per group of a prediction table."""
    base = metrics.confusion(scored, by)
    areas = metrics.ranking(scored, by, expected_rows=expected_rows)
    joined = base.join(areas, by) if by else with_row(base, areas)
    return joined.select(*by, *METRIC_NAMES)


@dataclass
class ModelRun:
    """One model's threshold, predictions of both later periods and their metrics."""

    model: FittedModel
    threshold: float
    predictions: DataFrame
    metrics: DataFrame

    @property
    def name(self) -> str:
        return self.model.name


def run_model(bench: Bench, name: str) -> ModelRun:
    """Fit on train, take the threshold from validation, apply it unchanged afterwards."""
    model = bench.fit(name)
    threshold = metrics.threshold_for_budget(score_table(model, bench.period("validation")), bench.budget)
    later = None
    for period in [p for p in ("backtest", "forward") if p in bench.cuts.names]:
        part = score_table(model, bench.period(period)).withColumn("period", F.lit(period))
        later = part if later is None else later.unionByName(part)
    predicted = metrics.predictions(later, threshold, label="y_true", score="y_score", keep=["period"])
    return ModelRun(model, threshold, predicted, metric_rows(predicted, ["period"]))


def benchmark(bench: Bench, models: list[str]) -> DataFrame:
    """(model, period) metrics of several models with their thresholds."""
    out = None
    for name in models:
        run = run_model(bench, name)
        part = run.metrics.select(F.lit(name).alias("model"), "period", F.lit(run.threshold).alias("threshold"),
                                  F.lit(run.model.seconds).alias("train_seconds"), *METRIC_NAMES)
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(scored: DataFrame, threshold: float) -> dict[str, float]:
    """Metrics of one small comparison as a dict."""
    with held(scored) as rows:
        predicted = metrics.predictions(rows, threshold, label="y_true", score="y_score")
        return metric_rows(predicted, []).first().asDict()


def rows_frame(spark: SparkSession, rows: list[dict], columns: str) -> DataFrame:
    """Result records (one per fit) as a table; absent fields are null."""
    names = [part.split()[0] for part in columns.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], columns)
