"""Running totals, running extremes and row numbers that never need one task per group.

Up to ``rows_per_slice`` rows a plain window is used. Beyond that rows get a slice number that grows
with their order, and every slice is processed on its own. Slices are cut level by level: Spark's range
partitioner samples its boundaries on the driver, so it makes at most ``spark.tidewatch.slicesPerLevel`` slices; where more are
needed, each of these is cut again by quantiles of a sample of its own, in parallel, until slices are small enough.
Totals of earlier slices are carried forward in two levels as well: inside blocks of slices, and over blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import materialize, rows_per_slice, run_once

SLICE = "_slice"
SLICES_PER_LEVEL_KEY = "spark.tidewatch.slicesPerLevel"
# Slices that a later level cuts one slice into, and sampled rows for each of them.
FAN, SAMPLED = 64, 100
BLOCK = 512
_POSITION = "_position"


def slices_per_level(spark: SparkSession) -> int:
    return int(spark.conf.get(SLICES_PER_LEVEL_KEY, "4096"))


def slice_count(rows: int, per_slice: int) -> int:
    return -(-rows // per_slice)


def _cut_again(df: DataFrame, order: Sequence[str], fan: int, slices: int, rows: int) -> DataFrame:
    """Every slice cut into up to ``fan``, at quantiles of a sample of its keys; equal keys stay together."""
    key = F.struct(*order)
    sample = df.select(SLICE, key.alias("_key")).sample(min(1.0, SAMPLED * fan * slices / rows), seed=5)
    tiled = sample.withColumn("_tile", F.ntile(fan).over(Window.partitionBy(SLICE).orderBy("_key")))
    cuts = (tiled.groupBy(SLICE, "_tile").agg(F.min("_key").alias("_low")).where(F.col("_tile") > 1)
            .groupBy(SLICE).agg(F.collect_set("_low").alias("_cuts")))
    inner = F.size(F.filter("_cuts", lambda low: low <= key))
    return df.join(cuts, SLICE, "left").withColumn(
        SLICE, F.col(SLICE) * fan + F.coalesce(inner, F.lit(0))).drop("_cuts")


def cut_slices(df: DataFrame, order: Sequence[str], expected_rows: int) -> tuple[DataFrame, str | None]:
    """Give rows a slice number that grows with ``order``; equal keys share a slice.

    Returns the input and ``None`` when it is small enough for plain windows.
    """
    spark = df.sparkSession
    limit = rows_per_slice(spark)
    if expected_rows <= limit:
        return df, None
    wanted = slice_count(expected_rows, limit)
    slices = min(wanted, slices_per_level(spark))
    ranged = df.repartitionByRange(slices, *order).withColumn(SLICE, F.spark_partition_id().cast("long"))
    placed = materialize(run_once(ranged))
    while slices < wanted:
        fan = min(FAN, -(-wanted // slices))
        placed = materialize(run_once(_cut_again(placed, order, fan, slices, expected_rows)))
        slices *= fan
    return placed, SLICE


# How values of earlier slices are put together: over a window or group, and two partial results.
_KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def carried(per_slice: DataFrame, by: Sequence[str], slices: str, columns: Mapping[str, tuple[str, str]],
            totals: Mapping[str, str] | None = None) -> DataFrame:
    """What all earlier slices add up to, one row per (group, slice), and totals of groups.

    ``columns``: output -> (kind, column). Slices are summed up inside blocks of ``BLOCK`` slices, and
    blocks over the group, so no window holds more rows than a block has slices or a group has blocks.
    """
    totals = dict(totals or {})
    local = per_slice.withColumn("_block", F.floor(F.col(slices) / BLOCK))
    inside = Window.partitionBy(*by, "_block").orderBy(slices).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)

    def in_block(kind, column):
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(slices))) if kind == "last" else _KINDS[kind][0](column)

    blocks = local.groupBy(*by, "_block").agg(
        *[in_block(kind, c).alias(f"_i_{n}") for n, (kind, c) in columns.items()],
        *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    outer = blocks.select(*by, "_block", *[_KINDS[kind][0](f"_i_{n}").over(over).alias(f"_o_{n}") for n, (kind, _) in columns.items()],
                          *[F.sum(f"_t_{n}").over(whole).alias(n) for n in totals])
    inner = local.select(*by, slices, "_block", *[_KINDS[kind][0](c).over(inside).alias(f"_i_{n}") for n, (kind, c) in columns.items()])
    return inner.join(outer, [*by, "_block"]).select(
        *by, slices, *[_KINDS[kind][1](F.col(f"_o_{n}"), F.col(f"_i_{n}")).alias(n) for n, (kind, _) in columns.items()], *totals)


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str],
                 totals: Mapping[str, str] | None = None, slices: str | None = None) -> DataFrame:
    """Add running sums (and group totals) of columns within ``by``, in ``order``.

    ``order`` must be unique within a group, or group peers must not straddle slices.
    """
    totals = dict(totals or {})
    if slices is None:
        ordered = Window.partitionBy(*by).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*by)
        out = {name: F.sum(c).over(ordered) for name, c in sums.items()}
        out.update({name: F.sum(c).over(whole) for name, c in totals.items()})
        return df.withColumns(out)

    keys = [*by, slices]
    ordered = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    per_slice = df.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_p_{n}") for n, c in sums.items()],
        *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    earlier = carried(per_slice, by, slices, {f"_b_{n}": ("sum", f"_p_{n}") for n in sums}, {n: f"_t_{n}" for n in totals})
    local = df.withColumns({n: F.sum(c).over(ordered) for n, c in sums.items()})
    joined = local.join(earlier, keys)
    return joined.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop(
        *[f"_b_{n}" for n in sums])


def reflected_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str],
                   slices: str | None = None) -> DataFrame:
    """Add running sums that are set back to 0 where they would fall below: max(0, s + x) row by row.

    That is the running sum above the least value it has had, 0 included. A run of rows acts on what follows
    as a pair (its sum, the least of its running sums), and pairs of neighbouring runs combine to a pair, so slices are
    folded to pairs and only pairs are carried; rows are shuffled once.
    """
    keys = [*by, slices] if slices else list(by)
    ordered = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumns({f"_s_{n}": F.sum(c).over(ordered) for n, c in sums.items()})
    local = local.withColumns({f"_m_{n}": F.min(f"_s_{n}").over(ordered) for n in sums})
    zero = F.lit(0.0)
    if slices is None:
        out = {n: F.col(f"_s_{n}") - F.least(zero, F.col(f"_m_{n}")) for n in sums}
        return local.withColumns(out).drop(*[f"_{k}_{n}" for k in "sm" for n in sums])
    pairs = local.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
                                     *[F.min(f"_m_{n}").alias(f"_l_{n}") for n in sums])
    before = carried(pairs, by, slices, {f"_b_{n}": ("sum", f"_t_{n}") for n in sums})
    pairs = pairs.join(before, keys).withColumns({f"_l_{n}": F.col(f"_b_{n}") + F.col(f"_l_{n}") for n in sums})
    least = carried(pairs, by, slices, {f"_e_{n}": ("min", f"_l_{n}") for n in sums})
    starts = before.join(least, keys)
    out = {n: F.col(f"_b_{n}") + F.col(f"_s_{n}") - F.least(zero, F.col(f"_e_{n}"), F.col(f"_b_{n}") + F.col(f"_m_{n}")) for n in sums}
    return local.join(starts, keys).withColumns(out).drop(*[f"_{k}_{n}" for k in "smbe" for n in sums])


def running_extreme(df: DataFrame, by: Sequence[str], order: Sequence[str],
                    minima: Mapping[str, str] | None = None, maxima: Mapping[str, str] | None = None,
                    slices: str | None = None) -> DataFrame:
    """Add running minima and maxima of columns within ``by``, in ``order``."""
    minima, maxima = dict(minima or {}), dict(maxima or {})
    keys = [*by, slices] if slices else list(by)
    ordered = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = {n: F.min(c).over(ordered) for n, c in minima.items()}
    out.update({n: F.max(c).over(ordered) for n, c in maxima.items()})
    local = df.withColumns(out)
    if slices is None:
        return local
    per_slice = df.groupBy(*keys).agg(*[F.min(c).alias(f"_p_{n}") for n, c in minima.items()],
                                      *[F.max(c).alias(f"_p_{n}") for n, c in maxima.items()])
    earlier = carried(per_slice, by, slices, {**{f"_b_{n}": ("min", f"_p_{n}") for n in minima},
                                              **{f"_b_{n}": ("max", f"_p_{n}") for n in maxima}})
    joined = local.join(earlier, keys)
    merged = {n: F.least(n, f"_b_{n}") for n in minima}
    merged.update({n: F.greatest(n, f"_b_{n}") for n in maxima})
    return joined.withColumns(merged).drop(*[f"_b_{n}" for n in (*minima, *maxima)])


def last_seen(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str,
              slices: str | None = None, include_current: bool = True) -> DataFrame:
    """Add the latest non-null ``value`` at (or strictly before) each row."""
    keys = [*by, slices] if slices else list(by)
    end = Window.currentRow if include_current else -1
    ordered = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = df.withColumn(out, F.last(value, ignorenulls=True).over(ordered))
    if slices is None:
        return local
    rank = F.struct(*order)
    per_slice = df.where(value.isNotNull()).groupBy(*keys).agg(F.max_by(value, rank).alias("_p"))
    grid = df.select(*keys).distinct().join(per_slice, keys, "left")
    earlier = carried(grid, by, slices, {"_b": ("last", "_p")})
    return local.join(earlier, keys).withColumn(out, F.coalesce(out, "_b")).drop("_b")


BUCKETS = 16_384
_BUCKET = "_bucket"


def _number_in_buckets(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, place: Column, limit: int,
                       size: str | None) -> DataFrame | None:
    """Row numbers from counts per bucket of ``place``, or None where a bucket holds more than ``limit`` rows or a place is null."""
    low, high, nulls = df.agg(F.min(place), F.max(place), F.count_if(place.isNull())).first()
    if low is None or nulls:
        return None
    width = (high - low) // BUCKETS + 1
    rows = df.withColumn(_BUCKET, F.floor((place - F.lit(low)) / F.lit(width)).cast("long"))
    counted = rows.groupBy(*by, _BUCKET).agg(F.count("*").alias("_n"))
    if counted.agg(F.max("_n")).first()[0] > limit:
        return None
    earlier = carried(counted, by, _BUCKET, {"_before": ("sum", "_n")}, {size: "_n"} if size else {})
    ordered = Window.partitionBy(*by, _BUCKET).orderBy(*order)
    return (rows.join(earlier, [*by, _BUCKET])
            .select(*df.columns, (F.col("_before") + F.row_number().over(ordered) - 1).alias(out), *([size] if size else [])))


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, expected_rows: int,
                size: str | None = None, place: Column | None = None) -> DataFrame:
    """Number the rows of each group from 0 in ``order``; ``size`` adds the group's row count.

    ``place`` is a whole number that grows with ``order``, such as the time in microseconds. Large inputs are counted per
    bucket of it and numbered inside their bucket, which shuffles them once and stores nothing. Without it, or where rows
    crowd in one bucket, they are globally sorted once (the row key inside ``order`` keeps one hot
    timestamp from filling a partition) and numbered from the counts per partition.
    """
    whole = Window.partitionBy(*by)
    if expected_rows <= rows_per_slice(df.sparkSession):
        made = {out: F.row_number().over(whole.orderBy(*order)) - 1}
        if size:
            made[size] = F.count("*").over(whole)
        return df.withColumns(made)
    if place is not None:
        numbered = _number_in_buckets(df, by, order, out, place, rows_per_slice(df.sparkSession), size)
        if numbered is not None:
            return numbered
    parts = slice_count(expected_rows, rows_per_slice(df.sparkSession))
    totals = {size: "_n"} if size else {}
    if parts > slices_per_level(df.sparkSession):
        placed, slices = cut_slices(df, [*by, *order], expected_rows)
        ordered = Window.partitionBy(*by, slices).orderBy(*order)
        per_slice = placed.groupBy(*by, slices).agg(F.count("*").alias("_n"))
        earlier = carried(per_slice, by, slices, {"_before": ("sum", "_n")}, totals)
        return (placed.withColumn(_POSITION, F.row_number().over(ordered) - 1).join(earlier, [*by, slices])
                .withColumn(out, F.col("_before") + F.col(_POSITION)).drop(_POSITION, slices, "_before"))
    placed = materialize(
        df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
        .withColumn(_POSITION, F.monotonically_increasing_id()))
    placed = placed.withColumn(SLICE, F.shiftright(_POSITION, 33))
    per_slice = placed.groupBy(*by, SLICE).agg(F.count("*").alias("_n"), F.min(_POSITION).alias("_first"))
    earlier = carried(per_slice, by, SLICE, {"_before": ("sum", "_n")}, totals)
    return (placed.join(per_slice.drop("_n"), [*by, SLICE]).join(earlier, [*by, SLICE])
            .withColumn(out, F.col("_before") + F.col(_POSITION) - F.col("_first"))
            .drop(_POSITION, SLICE, "_first", "_before"))
