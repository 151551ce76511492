"""Readers that map raw flow exports onto the common schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.flows import with_derived
from tidewatch.schema import LABEL, TIME, static_schema

# Raw column names of the bidirectional export and the netflow line layout.
BIDIRECTIONAL = {
    "stime": TIME, "dur": "flow_duration", "spkts": "forward_packets", "dpkts": "backward_packets",
    "sbytes": "forward_bytes", "dbytes": "backward_bytes", "label": LABEL, "proto": "protocol",
}
REQUIRED = ["flow_duration", "forward_packets", "backward_packets", "forward_bytes", "backward_bytes"]
NETFLOW = ["timestamp", "duration", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flags",
           "tos", "tos_field", "packets", "bytes", "label", "attack"]
NETFLOW_LABELS = {"background": 0, "blacklist": 1}


def map_bidirectional(raw: DataFrame) -> DataFrame:
    """Raw bidirectional columns (any case) to the common schema with derived measures.

    Rows without a readable start time are dropped; a missing label means benign. Columns
    outside the mapping are never read from the file.
    """
    names = [c.strip().lower() for c in raw.columns]
    frame = raw.toDF(*names).withColumnsRenamed({k: v for k, v in BIDIRECTIONAL.items() if k in names})
    missing = [c for c in REQUIRED if c not in frame.columns]
    if missing:
        raise ValueError(f"the flow export lacks expected columns: {missing}")
    kept = [c for c in BIDIRECTIONAL.values() if c in frame.columns]
    frame = frame.select(*kept).withColumn(
        TIME, F.timestamp_seconds(F.col(TIME).try_cast("double")).cast("timestamp_ntz")).na.drop(subset=[TIME])
    if LABEL in kept:
        frame = frame.withColumn(LABEL, F.coalesce(F.col(LABEL).try_cast("double"), F.lit(0)).cast("int"))
    return with_derived(frame)


def bidirectional_flows(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Mapped flows; ``max_rows`` keeps the earliest rows by time, ties by row hash."""
    flows = map_bidirectional(spark.read.parquet(path))
    if not max_rows:
        return flows
    order = [c for c, _ in flows.dtypes]
    return flows.orderBy(TIME, F.xxhash64(*order)).limit(max_rows)


def netflow_fields(lines: DataFrame, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Split comma-separated netflow lines into named text fields; absent trailing ones are null."""
    parts = F.split(F.col(line), ",")
    return lines.where(F.length(F.trim(line)) > 0).select(
        *keep, *[F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(NETFLOW)])


def map_netflow(fields: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed common columns from netflow fields.

    Labels other than background and blacklist have no meaning here, and rows with an
    unreadable time are unusable: both are dropped.
    """
    text = F.lower(F.trim("label"))
    label: Column = F.lit(None).cast("int")
    for name, value in NETFLOW_LABELS.items():
        label = F.when(text == name, value).otherwise(label)
    frame = fields.select(
        *keep,
        F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias(TIME),
        F.col("duration").try_cast("double").alias("flow_duration"),
        F.col("packets").try_cast("double").alias("total_packets"),
        F.col("bytes").try_cast("double").alias("total_bytes"),
        F.trim("protocol").alias("protocol"), F.trim("flags").alias("tcp_flags"),
        F.col("tos").try_cast("double").alias("tos"), label.alias(LABEL))
    return frame.na.drop(subset=[TIME, LABEL])


def _without_tar_framing(line: Column) -> Column:
    """Text of one line of a decompressed tar stream, without headers and padding.

    A header block ends right before the first line of its file; padding is NUL bytes.
    """
    after_header = F.regexp_extract(line, r"([^\x00]*)$", 1)
    plain = F.translate(line, "\x00", "")
    return F.when(F.contains(line, F.lit("ustar")), after_header).otherwise(plain)


def netflow_lines(spark: SparkSession, paths: Sequence[str], max_rows_per_file: int | None = None) -> DataFrame:
    """Lines of netflow exports: plain CSV, gzip or .tar.gz with one CSV inside.

    The text reader streams a compressed archive in one task without holding it, on any
    file system Spark reads; archives run in parallel. A cap counts data lines in file order.
    """
    if not paths:
        raise FileNotFoundError("no netflow archives given")
    raw = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    lines = raw.withColumn("value", _without_tar_framing(F.col("value"))).where(F.length(F.trim("value")) > 0)
    if max_rows_per_file:
        order = Window.partitionBy("source_file").orderBy("_block", "_at")
        lines = lines.withColumn("_rank", F.row_number().over(order)).where(
            F.col("_rank") <= max_rows_per_file).drop("_rank")
    return lines.select("value", "source_file")


def netflow_archives(spark: SparkSession, paths: Sequence[str], max_rows_per_file: int | None = None) -> DataFrame:
    """All archives as one common table; ``source_file`` names the archive of each row."""
    lines = netflow_lines(spark, paths, max_rows_per_file)
    fields = netflow_fields(lines, keep=["source_file"])
    return with_derived(map_netflow(fields, keep=["source_file"]))


def ingest_netflow(spark: SparkSession, paths: Sequence[str], target: str, partitions: int = 200) -> None:
    """Turn archives into Parquet once, so that later jobs read splittable, prunable files."""
    rows = netflow_archives(spark, paths).withColumn("date", F.to_date(TIME))
    rows.repartition(partitions, "date", F.pmod(F.xxhash64(TIME, "total_bytes"), F.lit(partitions))).write.mode(
        "errorifexists").partitionBy("date").parquet(target)


def static_table(spark: SparkSession, path: str) -> DataFrame:
    """The 45-column CSV release with a header."""
    return spark.read.schema(static_schema()).csv(path, header=True, enforceSchema=True)


SOURCES: dict[str, Callable[..., DataFrame]] = {
    "bidirectional": bidirectional_flows, "netflow": netflow_archives, "static": static_table,
}


def source(name: str) -> Callable[..., DataFrame]:
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; known: {sorted(SOURCES)}")
    return SOURCES[name]
