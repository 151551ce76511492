"""Flow tables built from the event and line-item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.flows import with_derived


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as undirected flows, one row per event, keyed by event_id."""
    packets = F.get_json_object("props", "$.k").try_cast("bigint") + 1
    return table(spark, folder, "events").select(
        "event_id", F.col("ts").alias("timestamp"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("value").alias("flow_duration"),
        packets.cast("double").alias("total_packets"),
        (F.col("value") * packets).alias("total_bytes"),
        F.element_at(F.array(F.lit("TCP"), F.lit("UDP"), F.lit("ICMP")),
                     (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("protocol"),
        (F.col("value") / (F.col("value") + 50.0)).alias("score"))


def lineitem_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as bidirectional flows on whole dates (many equal timestamps)."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_shipdate").alias("timestamp"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_tax") * 100.0).alias("flow_duration"),
        F.col("l_quantity").alias("forward_packets"),
        F.col("l_linenumber").cast("double").alias("backward_packets"),
        F.col("l_extendedprice").alias("forward_bytes"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("backward_bytes"),
        F.col("l_linestatus").alias("protocol"),
        (F.col("l_discount") * 10.0).alias("score"))


def events_common(spark: SparkSession, folder: str) -> DataFrame:
    return with_derived(event_flows(spark, folder))


def lineitem_common(spark: SparkSession, folder: str) -> DataFrame:
    return with_derived(lineitem_flows(spark, folder))


LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
EVENT_KEY = ["event_id"]
