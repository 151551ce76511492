"""Population stability index over reference quantile bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-6


def inner_edges(quantiles: Sequence[float]) -> list[float] | None:
    """Distinct inner bin edges from reference quantiles; None when they collapse to one value.

    The outer edges are open, so the smallest and the largest are left out.
    """
    distinct = sorted(set(quantiles))
    return distinct[1:-1] if len(distinct) >= 2 else None


def bin_of(bins: int):
    """Number of inner edges at or below the value; unused edge slots count 0."""
    number = F.lit(0)
    for i in range(bins - 1):
        edge = F.get(F.col("edges"), F.lit(i))
        number = number + F.when(F.col("value") >= edge, 1).otherwise(0)
    return number


def bin_table(long: DataFrame, edges: DataFrame, ids: Sequence[str], bins: int = 10,
              weight: str | None = None) -> DataFrame:
    """(ids) with one count per bin (b0..) and their total ``n``.

    Bins are counted before the shuffle, so a row per group and task is exchanged. The
    edges are one short array per feature and are broadcast.
    """
    amount = F.lit(1) if weight is None else F.col(weight)
    placed = long.join(F.broadcast(edges), "feature").withColumn("_bin", bin_of(bins))
    return placed.groupBy(*ids).agg(
        *[F.sum(F.when(F.col("_bin") == i, amount).otherwise(0)).alias(f"b{i}") for i in range(bins)],
        F.sum(amount).alias("n"))


def psi(reference: DataFrame, windows: DataFrame, edges: DataFrame, ids: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, ids) -> psi and sample sizes from bin tables.

    Empty bins are floored, not skipped. The reference has one row per feature.
    """
    old = reference.select("feature", F.col("n").alias("n_reference"), *[F.col(f"b{i}").alias(f"r{i}") for i in range(bins)])
    joined = windows.join(F.broadcast(old.join(edges, "feature")), "feature")
    total = F.lit(0.0)
    for i in range(bins):
        p = F.greatest(F.col(f"r{i}") / F.col("n_reference"), F.lit(FLOOR))
        q = F.greatest(F.col(f"b{i}") / F.col("n"), F.lit(FLOOR))
        total = total + F.when(F.size("edges") >= i, (q - p) * F.log(q / p)).otherwise(F.lit(0.0))
    value = F.when(F.col("edges").isNull(), F.lit(0.0)).otherwise(total)
    return joined.select("feature", *ids, value.alias("psi"), "n_reference", F.col("n").alias("n_window"))
