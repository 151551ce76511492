"""Writers for result tables and documents; a run is written once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.drift import require_events
from tidewatch.session import materialize

ONCE = "errorifexists"


def write_table(df: DataFrame, root: str, run: str, name: str, partition_by: Sequence[str] = (),
                form: str = "parquet") -> str:
    """A result table under its run; refuses to replace an earlier one."""
    path = f"{root}/{run}/{name}"
    writer = df.write.mode(ONCE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(form).save(path)
    return path


def write_predictions(df: DataFrame, root: str, run: str) -> str:
    """Predictions split by period and model, so a report reads only what it needs."""
    return write_table(df, root, run, "predictions", [c for c in ("period", "model") if c in df.columns])


def write_drift(events: DataFrame, root: str, run: str) -> str:
    """The drift table of a run. A run that measured nothing is an error and leaves no table."""
    return write_table(require_events(materialize(events)), root, run, "drift_events")


def write_document(df: DataFrame, root: str, run: str, name: str) -> str:
    """A nested one-row result as JSON."""
    path = f"{root}/{run}/{name}"
    public(df).coalesce(1).write.mode(ONCE).json(path)
    return path


def _private(name: str) -> bool:
    return name.startswith("_") or name.endswith("_object")


def _pruned(kind: T.DataType, value: Column) -> Column:
    """A value without internal fields and keys at any depth; map keys become text, as JSON has no others."""
    if isinstance(kind, T.StructType):
        kept = [_pruned(f.dataType, value[f.name]).alias(f.name) for f in kind.fields if not _private(f.name)]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.when(value.isNotNull(), F.create_map().cast("map<string,string>"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _pruned(kind.elementType, v))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), _pruned(kind.valueType, e["value"]).alias("value")))
        return F.map_from_entries(F.filter(entries, lambda e: ~(e["key"].startswith("_") | e["key"].endswith("_object"))))
    return value


def public(df: DataFrame) -> DataFrame:
    """Without internal columns, fields and map keys (``_x`` or ``x_object``), however deep they lie."""
    return df.select(*[_pruned(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields if not _private(f.name)])


def public_map(column: str):
    """A string-keyed map without internal keys."""
    return F.map_filter(column, lambda k, v: ~(k.startswith("_") | k.endswith("_object")))


def write_features(df: DataFrame, path: str, features: str = "features") -> str:
    """A prepared feature matrix; names travel in the column metadata."""
    meta = df.schema[features].metadata
    out = df.withColumn(features, vector_to_array(features))
    out.withMetadata(features, {"feature_names": meta.get("feature_names", [])}).write.mode(ONCE).parquet(path)
    return path


def read_features(spark: SparkSession, path: str, features: str = "features") -> DataFrame:
    """A stored feature matrix as vectors, names back in the column metadata."""
    df = spark.read.parquet(path)
    meta = df.schema[features].metadata
    return df.withColumn(features, array_to_vector(features)).withMetadata(features, meta)


def save_model(model: Transformer, path: str) -> None:
    PipelineModel(stages=[model]).write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
