"""Derived flow measures, summaries and the basic row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions.columns import nonnegative, rate, share


def with_derived(df: DataFrame) -> DataFrame:
    """Totals, rates, sizes, logs and direction ratios from the observed counters.

    Zero-length or empty flows get rate 0. Direction ratios appear only when the source
    has both byte directions.
    """
    directed = ({"forward_bytes", "backward_bytes"} <= set(df.columns))
    names = {"dur": "flow_duration"}
    if directed:
        names.update(fp="forward_packets", bp="backward_packets", fb="forward_bytes", bb="backward_bytes")
    else:
        names.update(packets="total_packets", bytes="total_bytes")
    base = df.withColumns({f"_{k}": nonnegative(df, c) for k, c in names.items()})
    dur = F.col("_dur")
    if directed:
        base = base.withColumns({"total_packets": F.col("_fp") + F.col("_bp"),
                                 "total_bytes": F.col("_fb") + F.col("_bb")})
    else:
        base = base.withColumns({"total_packets": F.col("_packets"), "total_bytes": F.col("_bytes")})
    packets, size = F.col("total_packets"), F.col("total_bytes")
    out = {
        "packet_rate": rate(packets, dur), "byte_rate": rate(size, dur),
        "mean_packet_size": rate(size, packets), "bytes_per_packet": rate(size, packets),
        "duration_log1p": F.log1p(dur), "packets_log1p": F.log1p(packets), "bytes_log1p": F.log1p(size),
    }
    if directed:
        out["bytes_ratio"] = share(F.col("_fb"), size)
        out["packets_ratio"] = share(F.col("_fp"), packets)
    return base.withColumns(out).drop(*[f"_{k}" for k in names])


def dataset_summary(df: DataFrame, name: str, ts: str = schema.TIME, label: str = schema.LABEL) -> DataFrame:
    """One row: size, time range, label counts and attack rate."""
    per_label = df.groupBy(label).agg(
        F.count("*").alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return per_label.agg(
        F.sum("n").cast("long").alias("row_count"),
        F.min("lo").alias("time_min"), F.max("hi").alias("time_max"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col(label).cast("string"), F.col("n"))))).alias("label_counts"),
        (F.sum(F.col(label) * F.col("n")) / F.sum("n")).alias("attack_rate"),
    ).select(
        F.lit(name).alias("dataset"), "row_count",
        F.lit(len(schema.flow_features(df))).cast("long").alias("features"),
        F.lit(len(schema.flow_features(df, "number", ("core", "derived")))).cast("long").alias("cross_dataset_features"),
        F.lit(({"forward_bytes", "backward_bytes"} <= set(df.columns))).alias("has_direction"),
        "time_min", "time_max", "label_counts", "attack_rate")


def feature_fingerprint(df: DataFrame, names: str) -> DataFrame:
    """16 hex digits identifying a set of column names, from a column of names."""
    joined = F.array_join(F.array_sort(F.collect_set(names)), "\n")
    return df.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def trimmed(df: DataFrame) -> DataFrame:
    """Trim every string column; rows and nulls stay."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.trim(c) for c in strings}) if strings else df


def require_binary(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """Fail on a null or non-binary target; otherwise the table with an int target."""
    nulls, others = df.agg(
        F.count_if(F.col(label).isNull()),
        F.count_if(F.col(label).isNotNull() & ~F.col(label).cast("double").isin(0.0, 1.0))).first()
    if nulls:
        raise ValueError(f"target {label!r} has {nulls} missing values")
    if others:
        raise ValueError(f"target {label!r} has {others} values other than 0 and 1")
    return df.withColumn(label, F.col(label).cast("int"))


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in a stated order (per-partition top-n, then a merge)."""
    return df.orderBy(*order).limit(n)
