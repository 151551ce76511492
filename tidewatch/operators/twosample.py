"""Distances between a reference sample and the windows of a later period.

Reference and windows are reduced to value counts and placed on one sorted axis per
feature. The reference appears once, however many windows there are: each window value
looks up the reference distribution at its own position (Kolmogorov-Smirnov), and each
window rank looks up the reference quantile function (Wasserstein).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import finite
from tidewatch.operators.running import last_seen, running_sums, slice_count
from tidewatch.session import rows_per_slice

REFERENCE = -1
RANK_SLICE = "_rank_slice"


def melt(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Wide features to (ids, feature, value), finite values only."""
    doubles = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    long = doubles.unpivot(list(ids), list(features), "feature", "value")
    return long.where(finite(F.col("value")))


def reference_counts(reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, n) of the reference sample."""
    return melt(reference, features).groupBy("feature", "value").agg(F.count("*").alias("n"))


def pooled_counts(ref_counts: DataFrame, windows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Value counts of both sides: feature, k (-1 = reference), value, nr, nw."""
    zero = F.lit(0).cast("long")
    ref = ref_counts.select("feature", F.lit(REFERENCE).cast("long").alias("k"), "value",
                            F.col("n").alias("nr"), zero.alias("nw"))
    tgt = (melt(windows, features, ["k"]).groupBy("feature", "k", "value").agg(F.count("*").alias("nw"))
           .select("feature", "k", "value", zero.alias("nr"), "nw"))
    return ref.unionByName(tgt)


def sorted_axis(pool: DataFrame, slices: str | None, centres: Mapping[str, float] | None = None) -> DataFrame:
    """Running sums along each feature of the pooled counts.

    Adds cum_r and cum_rv (reference rows and the sum of their centred values up to here, ties
    included), cum_w (window rows up to here), n_reference and n_window. Distances do not depend on the
    centre of a feature; sums of values far from 0 would lose digits without it.
    """
    centre = F.lit(0.0)
    for feature, value in (centres or {}).items():
        centre = F.when(F.col("feature") == feature, F.lit(float(value))).otherwise(centre)
    pool = pool.withColumn("centred", F.col("value") - centre).withColumn("nrv", F.col("nr") * F.col("centred"))
    by_feature = running_sums(pool, ["feature"], ["value", "k"],
                              {"cum_r": "nr", "cum_rv": "nrv"}, {"n_reference": "nr"}, slices)
    return running_sums(by_feature, ["feature", "k"], ["value"],
                        {"cum_w": "nw"}, {"n_window": "nw"}, slices)


def ranked_reference(pool: DataFrame, slices: str | None) -> DataFrame:
    """Reference values with their running counts, as ``pick_quantiles`` reads them."""
    ref = pool.where(F.col("k") == REFERENCE).withColumn("n", F.col("nr"))
    return running_sums(ref, ["feature"], ["value"], {"cum": "n"}, {"total": "n"}, slices)


def reference_lookup(axis: DataFrame, slices: str | None) -> DataFrame:
    """Add r_le and r_lt: reference rows at or below, and strictly below, each value."""
    mark = F.when(F.col("k") == REFERENCE, F.struct(
        F.col("value").alias("at"), (F.col("cum_r") - F.col("nr")).alias("before")))
    seen = last_seen(axis, ["feature"], ["value", "k"], mark, "_ref", slices)
    tied = F.coalesce(F.col("_ref.at") == F.col("value"), F.lit(False))
    return seen.withColumns({
        "r_le": F.col("cum_r"),
        "r_lt": F.when(tied, F.col("_ref.before")).otherwise(F.col("cum_r")),
    }).drop("_ref")


def ks_gap() -> Column:
    """Largest gap between the two distribution functions at one window value."""
    n_r, n_w = F.col("n_reference").cast("double"), F.col("n_window").cast("double")
    at = F.abs(F.col("r_le") / n_r - F.col("cum_w") / n_w)
    below = F.abs(F.col("r_lt") / n_r - (F.col("cum_w") - F.col("nw")) / n_w)
    return F.greatest(at, below)


def ks_distance(looked_up: DataFrame) -> DataFrame:
    """(feature, k) -> ks statistic and sample sizes."""
    return (looked_up.where(F.col("k") != REFERENCE).groupBy("feature", "k")
            .agg(F.max(ks_gap()).alias("ks"), F.first("n_reference").alias("n_reference"),
                 F.first("n_window").alias("n_window")))


def sample_distances(looked_up: DataFrame, expected_rows: int) -> DataFrame:
    """(feature, k) -> Wasserstein-1 and ks distances with the sample sizes.

    The distance is the area between the two quantile functions. Each window value owns a
    rank interval [r0, r1] on the reference's rank axis; the area over it follows from the
    running sum of reference values at r0, r1 and at the crossing point. Slices of the
    rank axis have equal width, which balances them by construction.
    """
    n_r, n_w = F.col("n_reference").cast("double"), F.col("n_window").cast("double")
    is_ref = F.col("k") == REFERENCE
    rank = F.when(is_ref, (F.col("cum_r") - F.col("nr")).cast("double")).otherwise(
        F.col("cum_w") * n_r / n_w)
    rows = looked_up.withColumn("r1", rank)
    parts = slice_count(expected_rows, rows_per_slice(looked_up.sparkSession))
    slices = None
    if parts > 1:
        slices = RANK_SLICE
        rows = rows.withColumn(slices, F.least(
            F.floor(F.col("r1") / n_r * parts).cast("int"), F.lit(parts - 1)))
    anchor = F.when(is_ref, F.struct(
        F.col("r1").alias("rank"), F.col("centred").alias("v"), (F.col("cum_rv") - F.col("nrv")).alias("sum")))
    rows = last_seen(rows, ["feature"], ["r1", "k", "value"], anchor, "_a", slices)
    rows = rows.where(~is_ref).withColumn(
        "h1", F.col("_a.sum") + (F.col("r1") - F.col("_a.rank")) * F.col("_a.v"))
    rows = last_seen(rows, ["feature", "k"], ["r1"], F.col("h1"), "h0", slices, include_current=False)
    h0, h1 = F.coalesce(F.col("h0"), F.lit(0.0)), F.col("h1")
    v, r1 = F.col("centred"), F.col("r1")
    r0 = (F.col("cum_w") - F.col("nw")) * n_r / n_w
    crossing, s_cross = F.col("r_le").cast("double"), F.col("cum_rv")
    area = (F.when(crossing >= r1, v * (r1 - r0) - (h1 - h0))
            .when(crossing <= r0, (h1 - h0) - v * (r1 - r0))
            .otherwise((v * (crossing - r0) - (s_cross - h0)) + ((h1 - s_cross) - v * (r1 - crossing))))
    return rows.groupBy("feature", "k").agg(
        F.greatest(F.sum(area / n_r), F.lit(0.0)).alias("wasserstein"), F.max(ks_gap()).alias("ks"),
        F.first("n_reference").alias("n_reference"), F.first("n_window").alias("n_window"))


def reference_moments(reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mu, sigma, n_reference): moments of the finite values, rows of the sample, in one pass."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), F.count("*").alias(f"n_{f}")]
    doubles = reference.select(*[F.col(f).cast("double").alias(f) for f in features])
    one = doubles.select(*[F.when(finite(F.col(f)), F.col(f)).alias(f) for f in features]).agg(*aggs)
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mu"),
                        F.col(f"s_{f}").alias("sigma"), F.col(f"n_{f}").alias("n_reference"))
               for f in features]
    return one.select(F.inline(F.array(*entries)))
