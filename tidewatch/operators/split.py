"""Chronological split into disjoint periods, and the guards against leakage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import micros
from tidewatch.schema import LABEL, PERIODS, TIME

MINUTE = 60_000_000


class TemporalLeakageError(RuntimeError):
    """A component would see rows from outside its period."""


@dataclass(frozen=True)
class TimeCuts:
    """The last timestamp of each period, as text, in period order."""

    names: tuple[str, ...]
    ends: tuple[str, ...]
    ts: str = TIME

    def bounds(self, name: str) -> tuple[str | None, str]:
        """(exclusive lower bound or None, inclusive upper bound) of one period."""
        if name not in self.names:
            raise TemporalLeakageError(f"period {name!r} is not part of this split {self.names}")
        i = self.names.index(name)
        return (self.ends[i - 1] if i else None), self.ends[i]

    def period(self, df: DataFrame, name: str) -> DataFrame:
        """Rows of one period; a plain time range, so it reaches the file scan."""
        low, high = self.bounds(name)
        kind = df.schema[self.ts].dataType
        ts = F.col(self.ts)
        out = df if low is None else df.where(ts > F.lit(low).cast(kind))
        return out if name == self.names[-1] else out.where(ts <= F.lit(high).cast(kind))

    def label(self, df: DataFrame, out: str = "period") -> DataFrame:
        """Tag every row with its period by comparing with at most three literals."""
        kind = df.schema[self.ts].dataType
        tag = None
        for name, end in zip(self.names[:-1], self.ends[:-1]):
            test = F.col(self.ts) <= F.lit(end).cast(kind)
            tag = F.when(test, name) if tag is None else tag.when(test, name)
        last = F.lit(self.names[-1])
        return df.withColumn(out, last if tag is None else tag.otherwise(last))


def find_cuts(df: DataFrame, train: float = 0.50, validation: float = 0.15, backtest: float = 0.15,
              forward: float = 0.20, use_forward: bool = True, ts: str = TIME) -> TimeCuts:
    """Size periods by row count and end each on a whole timestamp.

    Rows sharing a boundary timestamp stay in the earlier period. Counts per minute
    place every cut within one minute; a second, range-filtered scan resolves the exact
    timestamp inside those minutes, so no task ever sorts the full time axis.
    """
    fractions = [train, validation, backtest, forward] if use_forward else [
        train, validation, 1.0 - train - validation]
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError(f"period fractions must sum to 1, got {sum(fractions)}")
    names = PERIODS[: len(fractions)]

    kind = df.schema[ts].dataType
    us = micros(F.col(ts))
    minute = (us - F.pmod(us, F.lit(MINUTE))).alias("minute")
    per_minute = df.groupBy(minute).agg(F.count("*").alias("n"), F.max(ts).alias("latest"))
    # One row per minute: a decade is five million short rows.
    whole = Window.partitionBy(F.lit(0))
    axis = per_minute.withColumns({
        "cum": F.sum("n").over(whole.orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("n").over(whole)})
    first, running = F.col("cum") - F.col("n"), 0.0
    hits = [F.max("total").alias("total"), F.max("latest").cast("string").alias("latest")]
    for i, fraction in enumerate(fractions[:-1]):
        running += fraction
        position = F.least(F.greatest(F.bround(F.col("total") * F.lit(running), 0).cast("long"), F.lit(1)), F.col("total"))
        inside = (position > first) & (position <= F.col("cum"))
        hits += [F.max(F.when(inside, F.col("minute"))).alias(f"m{i}"),
                 F.max(F.when(inside, position - first)).alias(f"r{i}")]
    found = axis.agg(*hits).first()
    if not found.total:
        raise ValueError("the table has no usable rows")
    last, count = found.latest, len(fractions) - 1

    # The exact timestamps: only rows of the minutes that hold a cut are read again.
    def at(moment):
        return F.timestamp_micros(F.lit(moment)).cast(kind)

    lows = sorted({found[f"m{i}"] for i in range(count)})
    near = None
    for low in lows:
        test = (F.col(ts) >= at(low)) & (F.col(ts) < at(low + MINUTE))
        near = test if near is None else near | test
    instants = df.where(near).groupBy(ts).agg(F.count("*").alias("n")).withColumn(
        "minute", micros(F.col(ts)) - F.pmod(micros(F.col(ts)), F.lit(MINUTE))).withColumn(
        "cum", F.sum("n").over(Window.partitionBy("minute").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)))
    reached = [F.min(F.when((F.col("minute") == found[f"m{i}"]) & (F.col("cum") >= found[f"r{i}"]), F.col(ts))
                     ).cast("string").alias(f"e{i}") for i in range(count)]
    ends = list(instants.agg(*reached).first())
    ends.append(last)

    for earlier, later in zip(ends, ends[1:]):
        if earlier >= later:
            raise ValueError(
                f"period boundaries {ends} do not separate: the time axis is too coarse for {fractions}")
    return TimeCuts(tuple(names), tuple(ends), ts)


def period_rank(period: str = "period"):
    return F.array_position(F.array(*[F.lit(p) for p in PERIODS]), F.col(period))


def period_summary(labelled: DataFrame, ts: str = TIME, label: str = LABEL) -> DataFrame:
    """Rows, attacks, attack rate and time range of every period."""
    return labelled.groupBy("period").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
        F.count("*").alias("row_count"), F.sum(label).cast("long").alias("attacks"),
        F.round(F.avg(label), 6).alias("attack_rate"))


def order_violations(summary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Periods that start at or before the end of an earlier one (the table is tiny)."""
    earlier = Window.partitionBy(*by).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = summary.withColumn("_rank", period_rank())
    return (ranked.withColumn("previous_end", F.max("end_ts").over(earlier))
            .where(F.col("start_ts") <= F.col("previous_end")).drop("_rank"))


def require_ordered(summary: DataFrame) -> None:
    bad = order_violations(summary).first()
    if bad is not None:
        raise TemporalLeakageError(
            f"period {bad.period!r} starts at {bad.start_ts}, an earlier one reaches {bad.previous_end}")


def require_no_later_rows(df: DataFrame, limit: str, what: str = "slice", ts: str = TIME) -> None:
    """Refuse a table holding any row after ``limit``."""
    kind = df.schema[ts].dataType
    latest, late = df.agg(F.max(ts).cast("string"), F.max(ts) > F.lit(limit).cast(kind)).first()
    if late:
        raise TemporalLeakageError(f"{what} holds rows up to {latest}, past its limit {limit}")
