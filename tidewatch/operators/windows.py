"""Time windows: bucket floors, anchored tumbling and sliding windows, time ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import from_micros, micros
from tidewatch.schema import TIME

HOUR = 3_600_000_000
SECOND = 1_000_000


def bucket(ts: Column, size_us: int) -> Column:
    """Floor a timestamp to a bucket aligned on the epoch."""
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(size_us)))


def between(df: DataFrame, start: str | None, end: str | None, include_end: bool = False,
            ts: str = TIME) -> DataFrame:
    """Rows in [start, end) or [start, end]; literals fold, so the scan can skip files."""
    out = df
    kind = df.schema[ts].dataType
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        limit = F.lit(end).cast(kind)
        out = out.where(F.col(ts) <= limit if include_end else F.col(ts) < limit)
    return out


@dataclass(frozen=True)
class WindowPlan:
    """Windows anchored at the first row of a period, all in microseconds."""

    origin: int
    window: int
    stride: int
    rows: int
    shrunk: bool = False


def plan_windows(df: DataFrame, window: int, stride: int | None = None, ts: str = TIME) -> WindowPlan | None:
    """Anchor windows on the data; a window longer than the data shrinks to its span.

    One min/max job over the time column. Returns None for an empty table.
    """
    if window <= 0:
        raise ValueError(f"window must be positive, got {window}")
    stride = stride or window
    if stride <= 0:
        raise ValueError(f"stride must be positive, got {stride}")
    low, high, rows = df.agg(
        F.min(micros(F.col(ts))), F.max(micros(F.col(ts))), F.count("*")).first()
    if low is None:
        return None
    if high - low < window:
        window = max((high - low) // SECOND, 1) * SECOND
        return WindowPlan(low, window, min(stride, window), rows, shrunk=True)
    return WindowPlan(low, window, stride, rows)


def assign_windows(df: DataFrame, plan: WindowPlan, out: str = "k", ts: str = TIME,
                   origin: Column | None = None) -> DataFrame:
    """Tag each row with the number of every window that holds it.

    Pure arithmetic: tumbling windows add a column, sliding ones explode a short
    sequence, and no join is involved. ``origin`` replaces the common anchor by a column.
    """
    offset = micros(F.col(ts)) - (F.lit(plan.origin) if origin is None else origin)
    latest = F.floor(offset / F.lit(plan.stride)).cast("long")
    if plan.window == plan.stride:
        return df.withColumn(out, latest)
    earliest = F.greatest(
        F.floor((offset - F.lit(plan.window)) / F.lit(plan.stride)).cast("long") + 1, F.lit(0).cast("long"))
    numbers = F.when(earliest <= latest, F.sequence(earliest, latest)).otherwise(
        F.array().cast("array<bigint>"))
    return df.withColumn(out, F.explode(numbers))


def window_bounds(plan: WindowPlan, k: Column) -> dict[str, Column]:
    start = F.lit(plan.origin) + k * F.lit(plan.stride)
    return {"window_start": from_micros(start), "window_end": from_micros(start + F.lit(plan.window))}
