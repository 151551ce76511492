"""What a shift really did: standardised mean moves, median ratios and mixture distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.combine import with_row
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.twosample import melt


def shares(df: DataFrame, category: str, by: Sequence[str], out: str) -> DataFrame:
    counts = df.groupBy(*by, category).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(1)])))
    return counts.select(*by, category, (F.col("_n") / total).alias(out))


def mixture_distance(before: DataFrame, after: DataFrame, category: str, by: Sequence[str] = ()) -> DataFrame:
    """Total variation distance of a category between one table and each group of another.

    Levels a group lacks add the share they had before, which is whatever its own levels
    leave over; so one left join is enough, however many levels there are.
    """
    keys = list(by) or ["_all"]
    if not by:
        after = after.withColumn("_all", F.lit(0))
    p, q = shares(before, category, [], "p"), shares(after, category, keys, "q")
    both = q.join(p, category, "left").na.fill(0.0, ["p"])
    gaps = both.groupBy(*keys).agg(
        (0.5 * (F.sum(F.abs(F.col("p") - F.col("q"))) + 1.0 - F.sum("p"))).alias("tvd"),
        F.count("*").alias("levels_after"))
    old = with_row(p.agg(F.count("*").alias("levels_before")),
                   _top(p.withColumn("_o", F.lit(0)), ["_o"], category, "p", "top_before").drop("_o"))
    out = with_row(gaps.join(_top(q, keys, category, "q", "top_after"), keys), old)
    return out if by else out.drop("_all")


def _top(levels: DataFrame, by: Sequence[str], category: str, column: str, out: str, k: int = 5) -> DataFrame:
    """The k most frequent levels of each group as a map."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(column).desc(), category))
    top = levels.withColumn("_rank", rank).where(F.col("_rank") <= k)
    pairs = F.array_sort(F.collect_list(F.struct("_rank", category, F.round(column, 6).alias("share"))))
    entries = F.transform(pairs, lambda x: F.struct(x[category], x["share"]))
    return top.groupBy(*by).agg(F.map_from_entries(entries).alias(out))


def numeric_moves(before: DataFrame, after: DataFrame, features: Sequence[str], by: Sequence[str] = (),
                  expected_rows: int | None = None) -> DataFrame:
    """Per feature: means, Cohen's d (pooled sample variance), medians and their ratio."""
    if expected_rows is None:
        expected_rows = (before.count() + after.count()) * len(features)

    def side(df, keys, suffix):
        long = melt(df, features, keys)
        stats = long.groupBy(*keys, "feature").agg(
            F.avg("value").alias(f"mean_{suffix}"), F.var_samp("value").alias(f"var_{suffix}"),
            F.count("*").alias(f"n_{suffix}"))
        median = exact_quantiles(long, [*keys, "feature"], "value", [0.5], expected_rows)
        return stats.join(median.select(*keys, "feature", F.col("q").alias(f"median_{suffix}")), [*keys, "feature"])

    joined = side(after, list(by), "after").join(F.broadcast(side(before, [], "before")), "feature")
    sd = F.sqrt((F.col("var_before") + F.col("var_after")) / 2.0)
    move = F.col("mean_after") - F.col("mean_before")
    both_positive = (F.col("median_before") > 0) & (F.col("median_after") > 0)
    return (joined.where((F.col("n_before") >= 2) & (F.col("n_after") >= 2))
            .withColumn("cohens_d", F.when(sd > 0, move / sd).otherwise(0.0))
            .withColumn("median_ratio", F.when(both_positive, F.col("median_after") / F.col("median_before"))))


def verdict(moves: DataFrame, mixtures: DataFrame | None, rates: DataFrame, by: Sequence[str] = (),
            dropped: Sequence[str] = ()) -> DataFrame:
    """One row per shift: the largest effects, the class-rate change, and whether anything moved.

    ``rates`` holds rows_before, rows_after, attack_rate_before and attack_rate_after.
    """
    size = F.abs("cohens_d")
    keys = list(by)
    out = rates
    effects = moves.groupBy(*keys).agg(F.max(size).alias("max_abs_cohens_d"), F.avg(size).alias("mean_abs_cohens_d"))
    out = out.join(effects, keys, "left") if keys else with_row(out, effects)
    if mixtures is None:
        out = out.withColumn("max_categorical_tvd", F.lit(0.0))
    else:
        tvd = mixtures.groupBy(*keys).agg(F.max("tvd").alias("max_categorical_tvd"))
        out = out.join(tvd, keys, "left") if keys else with_row(out, tvd)
    out = out.na.fill(0.0, ["max_abs_cohens_d", "mean_abs_cohens_d", "max_categorical_tvd"])
    before, after = F.col("attack_rate_before"), F.col("attack_rate_after")
    moved = ((F.col("max_abs_cohens_d") >= 0.05) | (F.col("max_categorical_tvd") >= 0.05)
             | F.lit(bool(dropped)) | F.coalesce(F.abs(after - before) > 1e-6, F.lit(False)))
    return out.withColumns({
        "attack_rate_ratio": F.when(before != 0, after / before),
        "columns_removed": F.array(*[F.lit(c) for c in sorted(dropped)]).cast("array<string>"),
        "verified": moved})


def class_rates(before: DataFrame, after: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    old = before.agg(F.count("*").alias("rows_before"), F.avg(label).alias("attack_rate_before"))
    new = after.groupBy(*by).agg(F.count("*").alias("rows_after"), F.avg(label).alias("attack_rate_after"))
    return with_row(new, old)
