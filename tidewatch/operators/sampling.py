"""Hash-ordered samples: exact counts, independent of partitioning, no full sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.hashing import digest

PREFIX = 4


def mark_smallest(df: DataFrame, by: Sequence[str], order: str, quotas: DataFrame, tiebreak: Sequence[str],
                  out: str = "taken") -> DataFrame:
    """Flag the ``quota`` rows of each group with the smallest hash, exactly.

    Rows are counted per leading hash digits (65,536 buckets a group). Buckets below the
    boundary are taken whole and those above it not at all; only the rows of the boundary
    bucket are ranked, so a group holding most of the table costs no more than any other.
    """
    keys = list(by)
    tagged = df.withColumn("_bucket", F.substring(order, 1, PREFIX))
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(quotas, keys)
    room = F.col("quota") - F.col("_before")
    state = F.when(room >= F.col("_n"), "in").when(room <= 0, "out").otherwise("edge")
    known = tagged.join(placed.select(*keys, "_bucket", room.alias("_room"), state.alias("_state")), [*keys, "_bucket"])
    clear = known.where(F.col("_state") != "edge").withColumn(out, F.col("_state") == "in")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *tiebreak))
    edge = known.where(F.col("_state") == "edge").withColumn("_rank", rank).withColumn(
        out, F.col("_rank") <= F.col("_room")).drop("_rank")
    return clear.unionByName(edge).drop("_bucket", "_room", "_state")


def take_smallest(df: DataFrame, by: Sequence[str], order: str, quotas: DataFrame,
                  tiebreak: Sequence[str]) -> DataFrame:
    """Only the flagged rows of :func:`mark_smallest`."""
    return mark_smallest(df, by, order, quotas, tiebreak, "_taken").where("_taken").drop("_taken")


def stratified_halves(df: DataFrame, label: str, keys: Sequence[str], fraction: float = 0.5,
                      seed: int = 42) -> DataFrame:
    """Random train/rest split with the same class mix on both sides (column ``arm``)."""
    hashed = df.withColumn("_hash", digest(keys, seed))
    quotas = df.groupBy(label).agg(F.floor(F.count("*") * fraction).alias("quota"))
    marked = mark_smallest(hashed, [label], "_hash", quotas, keys, "_taken")
    return marked.withColumn("arm", F.when(F.col("_taken"), "train").otherwise("rest")).drop("_hash", "_taken")


def random_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n random rows of a table, the same ones on every run."""
    hashed = df.withColumns({"_hash": digest(keys, seed), "_one": F.lit(0)})
    quota = df.sparkSession.createDataFrame([(0, n)], "_one int, quota long")
    return take_smallest(hashed, ["_one"], "_hash", quota, keys).drop("_hash", "_one")
