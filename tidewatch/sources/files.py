"""File manifests: row counts and checksums against what is expected."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 8 << 20
MOST_TASKS = 10_000
# Schemes of stores that tasks open themselves, as Arrow names them; others are read by Spark.
OPENED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of whole files of any size, a few MB in memory at a time."""
    from pyarrow import fs

    for batch in batches:
        out = []
        for uri, content in zip(batch["uri"], batch["content"]):
            digest = hashlib.sha256(content or b"")
            if uri is None:
                out.append(digest.hexdigest())
                continue
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(path, buffer_size=0) as stream:
                while block := stream.read(CHUNK):
                    digest.update(block)
            out.append(digest.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "sha256": out})


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The columns of each Parquet file, from its footer."""
    from pyarrow import BufferReader, fs
    from pyarrow import parquet as pq

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.uri is None:
                schema = pq.read_schema(BufferReader(row.content))
            else:
                store, path = fs.FileSystem.from_uri(row.uri)
                schema = pq.read_schema(path, filesystem=store)
            out += [(row.path, i, f.name, str(f.type)) for i, f in enumerate(schema)]
        yield pd.DataFrame(out, columns=["path", "position", "column_name", "data_type"])


def _located(spark: SparkSession, folder: str, pattern: str) -> tuple[DataFrame, int]:
    """(path, uri, content) of files, and their number. In stores that tasks do not open themselves: content and no uri."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    scheme = F.regexp_extract("path", r"^([A-Za-z0-9]+):", 1)
    stores = listed.select("path").groupBy(scheme.alias("scheme")).agg(F.count("*").alias("n")).collect()
    tasks = max(1, min(MOST_TASKS, sum(r.n for r in stores)))
    if any(r.scheme not in OPENED for r in stores):
        return listed.select("path", F.lit(None).cast("string").alias("uri"), "content"), tasks
    names = F.create_map(*[F.lit(x) for pair in OPENED.items() for x in pair])
    # A path may hold characters that a URI cannot.
    rest = F.replace(F.url_encode(F.regexp_extract("path", r"^[A-Za-z0-9]+:/*(.*)$", 1)), F.lit("%2F"), F.lit("/"))
    slashes = F.when(scheme == "file", F.lit(":///")).otherwise(F.lit("://"))
    uri = F.concat(names[scheme], slashes, F.replace(rest, F.lit("+"), F.lit("%20")))
    return listed.select("path", uri.alias("uri"), F.lit(None).cast("binary").alias("content")), tasks


def file_columns(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, position, column_name, data_type) of every Parquet file, one task a file; only footers are read."""
    where, tasks = _located(spark, folder, pattern)
    rows = where.repartition(tasks, "path")
    return rows.mapInPandas(_footers, "path string, position int, column_name string, data_type string")


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, file, length, sha256) per file. Spark lists the files; a task streams one file through the hash.

    Files in stores that only Spark reads are taken from its binary reader, which holds files of up to 2 GB. Spark does
    not list empty files; a manifest reports them as missing.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    facts = listed.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")
    where, tasks = _located(spark, folder, pattern)
    rows = where.repartition(tasks, "path")
    return facts.join(rows.mapInPandas(_digests, "path string, sha256 string"), "path")


def file_facts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, row_count, sha256) per file; rows are lines below a header line."""
    lines = (spark.read.option("pathGlobFilter", pattern).text(folder)
             .groupBy(F.col("_metadata.file_name").alias("file"))
             .agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("row_count")))
    return file_hashes(spark, folder, pattern).select("file", "sha256").join(lines, "file", "left").na.fill(0, ["row_count"])


def manifest_check(facts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (file, expected_rows, expected_sha256) with a status each."""
    joined = manifest.join(facts, "file", "left")
    status = (F.when(F.col("row_count").isNull(), "missing")
              .when(F.col("row_count") != F.col("expected_rows"), "wrong-row-count")
              .when(F.col("sha256") != F.col("expected_sha256"), "checksum-mismatch").otherwise("ok"))
    return joined.withColumn("status", status)


def dataset_kind(checked: DataFrame) -> DataFrame:
    """One row: what the files on disk are, judged from their manifest status."""
    present = F.count_if(F.col("status") != "missing")
    counted = F.count_if(F.col("status").isin("ok", "checksum-mismatch"))
    kind = (F.when(present == 0, "missing")
            .when((counted == F.count("*")) & (F.count_if(F.col("status") == "ok") == F.count("*")), "research")
            .when(counted == F.count("*"), "unexpected-content")
            .when(present == F.count("*"), "development-sample").otherwise("incomplete"))
    return checked.agg(kind.alias("kind"), F.sum("row_count").alias("row_count"))


def catalogue_record(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Records of a catalogue document (a list under ``datasets``), all or one by name."""
    rows = spark.read.json(path, multiLine=True).select(F.inline("datasets"))
    return rows if name is None else rows.where(F.col("name") == name)


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The given paths that exist, asked of Spark's own file system layer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(conf).exists(where):
            out.append(p)
    return out
