"""Data-quality profiles of raw tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema
from tidewatch.operators.combine import fixed_rows
from tidewatch.operators.twosample import melt


def _hashable(kind: T.DataType, value: Column) -> Column:
    """Values that count as equal must hash alike: -0.0 is 0.0."""
    return value + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else value


def column_profile(df: DataFrame) -> DataFrame:
    """Type, nulls and distinct values of every column in one pass over the table.

    Values become 128-bit digests that are counted before the shuffle, so what is shuffled depends on the number of different
    values and not on their width or on the number of columns.
    """
    fields = df.schema.fields
    marks = [F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))]
    for i, f in enumerate(fields):
        value = _hashable(f.dataType, F.col(f"`{f.name}`"))
        marks.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit(7), value).alias("b"))))
    values = df.select(F.inline(F.array_compact(F.array(*marks)))).groupBy("i", "a", "b").agg(F.count("*").alias("n"))
    found = values.groupBy("i").agg(F.sum("n").alias("present"), F.count("*").alias("distinct_values"))
    # The first mark is in every row, so its count is the number of rows.
    every = found.agg(F.coalesce(F.max(F.when(F.col("i") == -1, F.col("present"))), F.lit(0)).alias("rows"),
                      F.map_from_entries(F.collect_list(F.struct("i", F.struct("present", "distinct_values")))).alias("facts"))
    names = fixed_rows(["i", "column_name", "data_type"], [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)])
    one = every.select("rows", "facts", F.inline(names)).withColumn("fact", F.try_element_at("facts", F.col("i")))
    present = F.coalesce(F.col("fact.present"), F.lit(0))
    return one.select(
        "column_name", "data_type", (F.col("rows") - present).alias("nulls"),
        F.coalesce(F.col("fact.distinct_values"), F.lit(0)).alias("distinct_values"), (present == 0).alias("all_null"),
        F.round(F.try_divide(100.0 * (F.col("rows") - present), F.col("rows")), 4).alias("null_percent"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows and surplus copies.

    Rows are counted by a 128-bit digest, with the least and the greatest of a third one, so nothing wide is shuffled and
    a huge group of copies is one row. Only if rows of one digest turn out to differ are rows grouped as they are.
    """
    parts = []
    for f in df.schema.fields:
        parts += [_hashable(f.dataType, F.col(f"`{f.name}`")), F.col(f"`{f.name}`").isNull()]
    digests = df.select(*[F.xxhash64(F.lit(seed), *parts).alias(n) for seed, n in ((1, "a"), (2, "b"), (3, "c"))])
    copies = digests.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    found = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
                       F.count_if(F.col("low") != F.col("high")).alias("clashes")).first()
    if not found.clashes:
        return df.sparkSession.createDataFrame([(found.row_count, found.duplicates)], "row_count long, duplicates long")
    exact = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    return exact.agg(F.sum("_n").alias("row_count"), F.sum(F.col("_n") - 1).alias("duplicates"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def columns_of(df: DataFrame) -> DataFrame:
    """(column_name, data_type) of a table."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, data_type string")


def schema_difference(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(difference, column_name) of two column lists: missing from ``found``, extra in it, or of another type.

    Both have column_name and data_type, as ``files.file_columns`` reads them from files; repeated rows count once, and
    a type that is null fits any.
    """
    have, want = (d.select("column_name", "data_type").distinct() for d in (found, expected))
    types = want.join(have.withColumnRenamed("data_type", "other"), "column_name").where(F.col("data_type") != F.col("other"))
    parts = [(want.join(have, "column_name", "left_anti"), "missing"), (have.join(want, "column_name", "left_anti"), "extra"), (types, "type")]
    return reduce(DataFrame.unionByName, [d.select(F.lit(kind).alias("difference"), "column_name") for d, kind in parts]).distinct()


def target_counts(df: DataFrame, label: str = schema.LABEL, expected: Sequence[int] = (0, 1)) -> DataFrame:
    """Value counts of the target, with expected-but-absent and unexpected values marked."""
    counts = df.groupBy(F.col(label).cast("int").alias("target_value")).agg(F.count("*").alias("row_count"))
    want = df.sparkSession.createDataFrame([(int(v), True) for v in expected], "target_value int, wanted boolean")
    joined = counts.join(want, "target_value", "full")
    status = (F.when(F.col("wanted").isNull(), "unexpected").when(F.col("row_count").isNull(), "missing")
              .otherwise("ok"))
    return joined.select("target_value", F.coalesce("row_count", F.lit(0)).alias("row_count"),
                         status.alias("status"))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("row_count"))
    total = F.sum("row_count").over(Window.partitionBy(F.lit(1)))
    return counts.select(column, "row_count", F.round(100.0 * F.col("row_count") / total, 6).alias("percent"))


def row_shares(df: DataFrame, category: str, label: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised cross table of a category against listed label values."""
    wide = df.groupBy(category).pivot(label, list(values)).count().na.fill(0)
    total = reduce(Column.__add__, [F.col(f"`{v}`") for v in values])
    return wide.select(category, *[F.round(F.col(f"`{v}`") / total, 6).alias(v) for v in values])


def class_histogram(df: DataFrame, features: Sequence[str], label: str, bins: int = 50) -> DataFrame:
    """Density histogram of every feature per class, bins spanning the class's own range."""
    long = melt(df, features, [label])
    ranges = long.groupBy("feature", label).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    slot = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).alias("bin")
    # One range per (feature, class).
    counted = long.join(ranges, ["feature", label]).groupBy(
        "feature", label, slot, "n", width.alias("width")).agg(F.count("*").alias("row_count"))
    return counted.select("feature", label, "bin", "row_count",
                          F.round(F.col("row_count") / (F.col("n") * F.col("width")), 9).alias("density"))


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every feature pair over all rows, one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.round(f"r{i}", 6).alias("r"))
               for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*entries)))


def strong_pairs(pairs: DataFrame, floor: float = 0.8, k: int = 20) -> DataFrame:
    return pairs.where(F.abs("r") > floor).orderBy(F.abs("r").desc(), "first", "second").limit(k)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of every group; Spark prunes to n per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def feature_policy(names: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Policy report over tables of column names: forbidden ones present, sets available and missing."""
    known = F.col(column).isin(*schema.STATIC_COLUMNS, *schema.EXCLUDED_FEATURES)

    def fixed(values):
        return F.array(*[F.lit(v) for v in values])

    full, restricted, excluded = map(fixed, (
        schema.FULL_FEATURES, schema.RESTRICTED_FEATURES, schema.EXCLUDED_FEATURES))
    # Only known names are collected; unknown ones are merely counted.
    report = names.groupBy(*by).agg(F.count_distinct(column).alias("columns_seen"), F.collect_set(F.when(known, F.col(column))).alias("seen"))
    return report.select(
        *by, "columns_seen",
        F.array_intersect(excluded, "seen").alias("excluded_present"),
        F.array_intersect(full, "seen").alias("full_available"),
        F.array_except(full, "seen").alias("full_missing"),
        F.array_intersect(restricted, "seen").alias("restricted_available"),
        F.array_except(restricted, "seen").alias("restricted_missing")).withColumn("policy_compliant", F.size("excluded_present") == 0)
