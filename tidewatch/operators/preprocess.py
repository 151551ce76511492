"""Feature preparation fitted on one period and applied to all: a fit is one small aggregate."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.running import number_rows
from tidewatch.operators.split import require_no_later_rows
from tidewatch.operators.twosample import melt
from tidewatch.schema import check_model_inputs
from tidewatch.session import materialize


@dataclass(frozen=True)
class FittedFeatures:
    """Means, deviations, fill values and category levels learnt from the training rows."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    means: dict[str, float]
    deviations: dict[str, float]
    levels: dict[str, tuple[str, ...]]
    medians: dict[str, float]
    modes: dict[str, str]

    @property
    def names(self) -> list[str]:
        """Output feature names: numeric ones, then ``column=level``."""
        return [*self.numeric, *[f"{c}={level}" for c in self.categorical for level in self.levels[c]]]

    def scaled(self, column: str) -> Column:
        value = F.col(column).cast("double")
        if column in self.medians:
            value = F.coalesce(F.when(~F.isnan(value), value), F.lit(self.medians[column]))
        spread = self.deviations[column]
        return (value - F.lit(self.means[column])) / F.lit(spread if spread > 0 else 1.0)

    def indicator(self, column: str, level: str) -> Column:
        value = F.col(column).cast("string")
        if column in self.modes:
            value = F.coalesce(value, F.lit(self.modes[column]))
        return F.coalesce((value == level).cast("double"), F.lit(0.0))

    def columns(self) -> dict[str, Column]:
        out = {c: self.scaled(c) for c in self.numeric}
        for c in self.categorical:
            out.update({f"{c}={level}": self.indicator(c, level) for level in self.levels[c]})
        return out

    def wide(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Scaled and one-hot encoded columns; a level unseen in training is all zeros."""
        return df.select(*keep, *[c.alias(n) for n, c in self.columns().items()])

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        """The table with one feature vector for MLlib; names go to the column metadata.

        Each category is one sparse vector over its levels, however many there are: a level's place is looked up in the fitted
        index, and levels that are unseen or null share a place past the last one, which the encoder leaves out.
        """
        mark = "_"
        while any(c.startswith(mark) for c in [*df.columns, out]):
            mark += "_"
        made = {f"{mark}f{i}": self.scaled(c) for i, c in enumerate(self.numeric)}
        full, parts = df.withColumns(made), list(made)
        for i, c in enumerate(self.categorical):
            name, index, hot = f"{mark}c{i}", f"{mark}i{i}", f"{mark}h{i}"
            value = F.col(c).cast("string")
            full = full.withColumn(name, F.coalesce(value, F.lit(self.modes[c])) if c in self.modes else value)
            if not self.levels[c]:
                continue
            indexer = StringIndexerModel.from_labels(list(self.levels[c]), inputCol=name, outputCol=index, handleInvalid="keep")
            full = indexer.transform(full)
            full = OneHotEncoder(inputCols=[index], outputCols=[hot], dropLast=True).fit(full).transform(full)
            parts.append(hot)
        assembled = VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep").transform(full)
        added = [x for x in assembled.columns if x not in df.columns and x != out]
        return assembled.withMetadata(out, {"feature_names": self.names}).drop(*added)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the fitted state as one JSON row."""
        row = spark.createDataFrame([(json.dumps(asdict(self)),)], "value string")
        row.coalesce(1).write.mode("errorifexists").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedFeatures":
        state = json.loads(spark.read.text(path, wholetext=True).first().value)
        tuples = {k: tuple(state[k]) for k in ("numeric", "categorical")}
        return cls(**{**state, **tuples, "levels": {c: tuple(v) for c, v in state["levels"].items()}})

    def provenance(self) -> dict[str, object]:
        return {"numeric_features": list(self.numeric), "categorical_features": list(self.categorical),
                "scaler_mean": [round(self.means[c], 6) for c in self.numeric],
                "categories": {c: list(v) for c, v in self.levels.items()}}


def fit_features(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                 cutoff: str | None = None, impute: bool = False,
                 expected_rows: int | None = None) -> FittedFeatures:
    """Learn scaling (population deviation) and category levels from the training rows.

    ``cutoff`` refuses rows past the training period. ``impute`` also learns medians and
    modes, and the scaling then describes the filled columns.
    """
    check_model_inputs([*numeric, *categorical])
    if cutoff is not None:
        require_no_later_rows(train, cutoff, "training rows")
    medians, modes = {}, {}
    if impute:
        rows = train.count() if expected_rows is None else expected_rows
        found = exact_quantiles(melt(train, numeric), ["feature"], "value", [0.5], rows * max(len(numeric), 1))
        medians = {r.feature: r.q for r in found.collect()}
        if categorical:
            modes = train.agg(*[F.mode(F.col(c).cast("string"), deterministic=True).alias(c)
                                for c in categorical]).first().asDict()

    def filled(c):
        value = F.col(c).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(medians[c])) if c in medians else value

    aggs = [F.avg(filled(c)).alias(f"m_{i}") for i, c in enumerate(numeric)]
    aggs += [F.stddev_pop(filled(c)).alias(f"s_{i}") for i, c in enumerate(numeric)]
    stats = train.agg(*aggs).first() if aggs else None
    levels = {}
    for c in categorical:
        seen = train.select(F.col(c).cast("string").alias(c)).distinct().where(F.col(c).isNotNull())
        levels[c] = tuple(r[0] for r in seen.orderBy(c).collect())
    return FittedFeatures(
        tuple(numeric), tuple(categorical),
        {c: stats[f"m_{i}"] or 0.0 for i, c in enumerate(numeric)},
        {c: stats[f"s_{i}"] or 0.0 for i, c in enumerate(numeric)}, levels, medians, modes)


@dataclass(frozen=True)
class LevelTable:
    """The levels of one category as a table (level, place from 0), for more of them than a driver should hold."""

    column: str
    table: DataFrame
    size: int

    def vectors(self, df: DataFrame, fitted: FittedFeatures, out: str = "features") -> DataFrame:
        """The table with one sparse vector per row: the numeric features of ``fitted``, then the levels.

        Places are joined; an unseen or null level sets none. The vector carries no names, as they would all go to the driver.
        """
        width = len(fitted.numeric) + self.size
        cells = [F.struct(F.lit(i).alias("i"), F.coalesce(fitted.scaled(c), F.lit(float("nan"))).alias("v")) for i, c in enumerate(fitted.numeric)]
        hot = F.struct((F.col("_place") + len(fitted.numeric)).cast("int").alias("i"), F.lit(1.0).alias("v"))
        placed = df.join(self.table.select(F.col("level").alias("_level"), F.col("place").alias("_place")),
                         F.col(self.column).cast("string") == F.col("_level"), "left")
        kept = F.filter(F.array(*cells, hot), lambda c: c["i"].isNotNull() & (c["v"] != 0.0))
        stored = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(width).alias("size"),
                          kept["i"].alias("indices"), kept["v"].alias("values"))
        # JSON is the way from plain columns to a vector that needs no Python.
        kind = StructType([StructField(out, VectorUDT())])
        return placed.withColumn(out, F.from_json(F.to_json(F.struct(stored.alias(out))), kind)[out]).drop("_level", "_place")


def fit_level_table(train: DataFrame, column: str) -> LevelTable:
    """Every level of ``column`` with its place in ascending order; only their number reaches the driver."""
    seen = materialize(train.select(F.lit(0).alias("_one"), F.col(column).cast("string").alias("level")).distinct().where(F.col("level").isNotNull()))
    size = seen.count()
    return LevelTable(column, number_rows(seen, ["_one"], ["level"], "place", size).select("level", "place"), size)


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Row weights that give both classes the same total: n / (2 * n_class)."""
    counts = {int(r[label]): r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    choice = F.lit(1.0)
    for value, n in counts.items():
        choice = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(choice)
    return df.withColumn(out, choice)
