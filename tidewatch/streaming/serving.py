"""Stored model versions for streams: publishing, pinning, scoring, rolling refit.

A registry is a folder on shared storage. Every version has its own folder with the model and the
feature preparation, and one manifest row that is written last, so a version is either whole or absent. All state of
a rolling refit lies in files: model versions, the history of past batches and the stream's progress. A driver
that dies in the middle of a batch leaves nothing that the replay of this batch doesn't write again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import sinks
from tidewatch.functions.columns import micros
from tidewatch.operators import metrics
from tidewatch.operators.preprocess import FittedFeatures
from tidewatch.plans.models import FittedModel
from tidewatch.schema import LABEL, TIME

_MANIFEST = ("version int, name string, folder string, threshold double, rows long, seconds double, params string, "
             "constant double")


def read_or_none(spark: SparkSession, path: str, columns: str) -> DataFrame | None:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@dataclass(frozen=True)
class Version:
    """A stored model with the threshold that goes with it."""

    number: int
    model: FittedModel
    threshold: float


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def publish(self, number: int, model: FittedModel, threshold: float) -> None:
        """Store a version; one of the same number is replaced when the new one is whole."""
        folder = f"{self.root}/models/{number}-{uuid.uuid4().hex}"
        constant = None
        if model.name == "majority":
            constant = float(model.model)
        else:
            sinks.save_model(model.model, f"{folder}/model")
        model.features.save(self.spark, f"{folder}/features")
        row = (number, model.name, folder, float(threshold), int(model.rows), float(model.seconds),
               json.dumps(model.params), constant)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/manifest/number={number}")

    def versions(self) -> DataFrame:
        """The manifest: one row per whole version."""
        found = read_or_none(self.spark, f"{self.root}/manifest", _MANIFEST)
        return self.spark.createDataFrame([], _MANIFEST) if found is None else found.drop("number")

    def latest(self, at_most: int | None = None) -> int | None:
        rows = self.versions()
        return (rows if at_most is None else rows.where(F.col("version") <= at_most)).agg(F.max("version")).first()[0]

    def load(self, number: int) -> Version:
        row = self.versions().where(F.col("version") == number).first()
        if row is None:
            raise KeyError(f"no version {number} in {self.root}")
        features = FittedFeatures.load(self.spark, f"{row.folder}/features")
        model = row.constant if row.name == "majority" else sinks.load_model(f"{row.folder}/model")
        return Version(number, FittedModel(row.name, features, model, row.seconds, row.rows, json.loads(row.params)), row.threshold)

    def pinned(self, progress: str) -> Version:
        """The version that a stream with this progress folder uses: the latest one when it first asked."""
        path = f"{progress}-model"
        stored = read_or_none(self.spark, path, "version int")
        row = None if stored is None else stored.first()
        if row is None:
            number = self.latest()
            if number is None:
                raise KeyError(f"no version in {self.root}")
            self.spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("overwrite").parquet(path)
        else:
            number = row.version
        return self.load(number)


def score_stream(stream: DataFrame, version: Version) -> DataFrame:
    """The stream with y_score and y_pred of a stored model and its threshold; nothing is refitted."""
    return version.model.score(stream).withColumns({
        "y_pred": (F.col("y_score") >= F.lit(version.threshold)).cast("int"),
        "model_version": F.lit(version.number)})


class RollingRefit:
    """A foreachBatch step that scores each batch with the latest model, then refits.

    Batch n is scored by the latest version up to n, which has seen earlier batches only, and publishes version
    n + 1, fitted on the training rows and on the history: all batches so far, or those rows of them
    that are at most ``window_seconds`` older than the newest. The threshold meets ``budget`` on the history. History, scores
    and versions are kept per batch number, so a replay replaces what an interrupted attempt left, and never sees it.
    """

    def __init__(self, fit: Callable[[DataFrame], FittedModel], train: DataFrame, registry: ModelRegistry, history: str,
                 sink: str, window_seconds: int | None = None, budget: float = 0.05):
        self.fit, self.train, self.registry = fit, train, registry
        self.history, self.sink = history, sink
        self.window_seconds, self.budget = window_seconds, budget
        if registry.latest() is None:
            model = fit(train)
            registry.publish(0, model, self._threshold(model, train))

    def _threshold(self, model: FittedModel, rows: DataFrame) -> float:
        return metrics.threshold_for_budget(model.score(rows), self.budget, label=LABEL)

    def _known(self, spark: SparkSession, batch_id: int) -> DataFrame:
        seen = spark.read.parquet(self.history).where(F.col("batch_id") <= batch_id).drop("batch_id")
        if self.window_seconds is None:
            return seen
        latest = seen.agg(F.max(micros(F.col(TIME)))).first()[0]
        return seen.where(micros(F.col(TIME)) >= latest - self.window_seconds * 1_000_000)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            if rows.isEmpty():
                return
            version = self.registry.load(self.registry.latest(batch_id))
            score_stream(rows, version).write.mode("overwrite").parquet(f"{self.sink}/batch_id={batch_id}")
            rows.write.mode("overwrite").parquet(f"{self.history}/batch_id={batch_id}")
            known = self._known(batch.sparkSession, batch_id)
            model = self.fit(self.train.unionByName(known.select(*self.train.columns)))
            self.registry.publish(batch_id + 1, model, self._threshold(model, known))
        finally:
            rows.unpersist()


def run_refit(stream: DataFrame, step: RollingRefit, progress: str) -> None:
    """Process the available batches and stop; a later call, also of another driver, goes on behind them."""
    (stream.writeStream.foreachBatch(step).option("checkpointLocation", progress)
     .trigger(availableNow=True).start().awaitTermination())
