"""Sequential CUSUM over a whole ordered stream: own baseline, reset after each alarm.

The state after a reset depends on everything before it, so the recursion is not a plain prefix
operation. Still two passes over the rows are enough, however the stream is cut into slices. What a slice
does to *any* start state is a small table: before its first alarm a sum is the larger of (start + sum of steps so
far) and of what it would be from 0, so a start state can bring the first alarm forward only to a place where the sum of
steps reaches a new high, and what follows an alarm does not depend on the start. The first pass
computes these tables (``transfers``), one row a slice; they are applied one after the other to give every slice its true
start state (``start_states``); the second pass walks each slice from there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import finite
from tidewatch.operators.combine import with_row
from tidewatch.operators.profile import first_per_group
from tidewatch.operators.running import number_rows
from tidewatch.schema import TIME
from tidewatch.session import materialize, rows_per_slice

BLOCK = 4096
# Rows of a slice that Python holds at once; a task of the JVM may sort more (``rows_per_slice``).
PART_ROWS = 1 << 18
TRANSFER = ("feature string, part int, "
            + ", ".join(f"{side}_high array<double>, {side}_at array<long>, {side}_pos array<double>, {side}_neg array<double>" for side in ("up", "down"))
            + ", alarm_at long, pos double, neg double, up_sum double, down_sum double")


def walk(z: np.ndarray, usable: np.ndarray, pos: float, neg: float, threshold: float, drift: float,
         ) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One slice of the recursion from a start state; unusable values leave it unchanged."""
    statistic = np.zeros(len(z))
    alarm = np.zeros(len(z), dtype=bool)
    for i in np.flatnonzero(usable):
        pos = max(0.0, pos + z[i] - drift)
        neg = max(0.0, neg - z[i] - drift)
        statistic[i] = max(pos, neg)
        if statistic[i] > threshold:
            alarm[i] = True
            pos = neg = 0.0
    return statistic, alarm, pos, neg


def _run(up: np.ndarray, down: np.ndarray, at: int, threshold: float) -> tuple[int | None, float, float]:
    """From state (0, 0) before row ``at``: the row of the first alarm, or None and the state at the end."""
    pos = neg = 0.0
    for a in range(at, len(up), BLOCK):
        paths = []
        for step, start in ((up[a:a + BLOCK], pos), (down[a:a + BLOCK], neg)):
            total = start + np.cumsum(step)
            paths.append(total - np.minimum(np.minimum.accumulate(total), 0.0))
        hits = np.flatnonzero(np.maximum(*paths) > threshold)
        if len(hits):
            return a + int(hits[0]), 0.0, 0.0
        pos, neg = float(paths[0][-1]), float(paths[1][-1])
    return None, pos, neg


def transfer(z: np.ndarray, threshold: float, drift: float) -> dict[str, object]:
    """What a slice of usable values does to any start state with sums up to the threshold.

    ``alarm_at``: first alarm from (0, 0), and ``pos``, ``neg``: the state at the end from there. ``up_*`` and ``down_*``: rows before
    it where the sum of steps of a side reaches a new high; a start above threshold - high alarms there, and ends in (pos, neg).
    ``up_sum``, ``down_sum``: sums of all steps, for slices that start and end without an alarm.
    """
    up, down = z - drift, -z - drift
    ends: dict[int, tuple[float, float]] = {}  # state at the end after an alarm at a row

    def end_after(row: int) -> tuple[float, float]:
        path = []
        while row not in ends:
            path.append(row)
            following, pos, neg = _run(up, down, row + 1, threshold)
            if following is None:
                ends[row] = (pos, neg)
            else:
                row = following
        for r in path:
            ends[r] = ends[row]
        return ends[row]

    first, pos, neg = _run(up, down, 0, threshold)
    if first is not None:
        pos, neg = end_after(first)
    out: dict[str, object] = {"alarm_at": first, "pos": pos, "neg": neg, "up_sum": float(up.sum()), "down_sum": float(down.sum())}
    for side, steps in (("up", up), ("down", down)):
        total = np.cumsum(steps[:first])
        before = np.maximum(np.r_[0.0, np.maximum.accumulate(total)[:-1]] if len(total) else total, 0.0)
        rows = np.flatnonzero(total > before)
        states = [end_after(int(r)) for r in rows]
        out[f"{side}_high"], out[f"{side}_at"] = total[rows].tolist(), rows.tolist()
        out[f"{side}_pos"], out[f"{side}_neg"] = [s[0] for s in states], [s[1] for s in states]
    return out


def apply_transfer(table: dict[str, object], pos: float, neg: float, threshold: float) -> tuple[float, float]:
    """The state after a slice that starts in (pos, neg)."""
    found = []
    for side, start in (("up", pos), ("down", neg)):
        high = np.asarray(table[f"{side}_high"], float)
        # Highs rise along the slice: the first one that lifts the start over the threshold.
        k = int(np.searchsorted(start + high, threshold, "right"))
        if k < len(high):
            found.append((int(table[f"{side}_at"][k]), float(table[f"{side}_pos"][k]), float(table[f"{side}_neg"][k])))
    if found:
        return min(found)[1:]
    if table["alarm_at"] is not None and not pd.isna(table["alarm_at"]):
        return float(table["pos"]), float(table["neg"])
    return max(pos + table["up_sum"], float(table["pos"])), max(neg + table["down_sum"], float(table["neg"]))


def baselines(long: DataFrame, order: Sequence[str], warmup: int) -> DataFrame:
    """(feature, mu, sigma, last) from the first ``warmup`` finite values of each feature."""
    head = first_per_group(long.where(finite(F.col("x"))), ["feature"], order, warmup)
    sigma = F.stddev_pop("x")
    return head.groupBy("feature").agg(
        F.avg("x").alias("mu"), F.when(sigma > 0, sigma).otherwise(1.0).alias("sigma"),
        F.max(F.struct(*order)).alias("last"))


def sequential_cusum(df: DataFrame, features: Sequence[str], tiebreak: Sequence[str], threshold: float = 5.0,
                     drift: float = 0.5, warmup: int = 100, ts: str = TIME) -> DataFrame:
    """One row per observation and feature: statistic, alert and the standardised value.

    Rows carry their position, the first timestamp and their own.
    """
    order = [ts, *tiebreak]
    long = df.select(*order, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        order, list(features), "feature", "x")
    size = df.count()
    base = F.broadcast(baselines(long, order, warmup))
    ready = long.join(base, "feature", "left").withColumns({
        "z": (F.col("x") - F.col("mu")) / F.col("sigma"),
        "usable": finite(F.col("x")) & (F.struct(*order) > F.col("last"))})
    placed = number_rows(ready.select("feature", *order, "z", "usable"), ["feature"], order, "position",
                         size * len(features))
    span = min(rows_per_slice(df.sparkSession), PART_ROWS)
    placed = placed.withColumn("part", F.floor(F.col("position") / F.lit(span)).cast("int"))
    if size > span:
        placed = materialize(placed)
        starts = start_states(transfers(placed, threshold, drift), threshold)
        placed = placed.join(starts, ["feature", "part"])
    else:
        placed = placed.withColumns({"pos": F.lit(0.0), "neg": F.lit(0.0)})
    return emit(placed, threshold, drift, ts, tiebreak, df.agg(F.min(ts).alias("first_ts")))


def transfers(placed: DataFrame, threshold: float, drift: float) -> DataFrame:
    """One row per (feature, slice): what the slice does to any start state."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf.sort_values("position").loc[lambda d: d["usable"], "z"].to_numpy()
        row = {"feature": pdf["feature"].iat[0], "part": pdf["part"].iat[0], **transfer(z, threshold, drift)}
        return pd.DataFrame({k: pd.Series([v], dtype="Int64" if k == "alarm_at" else None) for k, v in row.items()})

    return placed.select("feature", "part", "position", "z", "usable").groupBy("feature", "part").applyInPandas(run, TRANSFER)


def start_states(tables: DataFrame, threshold: float) -> DataFrame:
    """(feature, part, pos, neg): the state each slice starts in. A feature's group has one row per slice."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pos = neg = 0.0
        out = []
        for row in pdf.sort_values("part").to_dict("records"):
            out.append((row["feature"], row["part"], pos, neg))
            pos, neg = apply_transfer(row, pos, neg, threshold)
        return pd.DataFrame(out, columns=["feature", "part", "pos", "neg"])

    return tables.groupBy("feature").applyInPandas(run, "feature string, part int, pos double, neg double")


def emit(placed: DataFrame, threshold: float, drift: float, ts: str, tiebreak: Sequence[str], first: DataFrame) -> DataFrame:
    """The output rows of every slice from its start state (pos, neg)."""
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    columns = ["feature", ts, *tiebreak, "position", "z", "usable"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", statistic double, alert boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        statistic, alarm, _, _ = walk(pdf["z"].to_numpy(), pdf["usable"].to_numpy(), pdf["pos"].iat[0], pdf["neg"].iat[0], threshold, drift)
        return pdf[columns].assign(statistic=statistic, alert=alarm)

    out = placed.groupBy("feature", "part").applyInPandas(run, schema)
    return with_row(out, first).select(
        "feature", F.col("first_ts").alias("window_start"), F.col(ts).alias("window_end"), *tiebreak,
        "statistic", F.lit(float(threshold)).alias("threshold"), "alert",
        F.when(F.col("usable"), F.col("z")).alias("effect_size"), (F.col("position") + 1).alias("n_window"))
