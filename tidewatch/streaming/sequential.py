"""Sequential CUSUM as a stateful stream operator."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidewatch.schema import TIME
from tidewatch.streaming.monitor import timed

OUTPUT = "feature string, timestamp timestamp, x double, statistic double, alert boolean, effect_size double, n_window long"
_STATE = StructType([StructField("n", LongType()), StructField("seen", LongType()), StructField("mean", DoubleType()),
                     StructField("m2", DoubleType()), StructField("pos", DoubleType()), StructField("neg", DoubleType())])
_WAITING = StructType([StructField("us", LongType()), StructField("x", DoubleType())])


class CusumProcessor(StatefulProcessor):
    """Per feature: baseline from the warm-up, two sums, reset after an alarm.

    Rows wait until the watermark passes them and are then taken in event-time order, so
    the result does not depend on how the input was cut into batches.
    """

    def __init__(self, threshold: float = 5.0, drift: float = 0.5, warmup: int = 100):
        self.threshold, self.drift, self.warmup = threshold, drift, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cusum", _STATE)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for pdf in rows:
            us = pd.DatetimeIndex(pdf[TIME]).as_unit("us").asi8
            fresh += list(zip(us.tolist(), pdf["x"].astype(float).tolist()))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(max(us for us, _ in fresh) // 1000 + 1)
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def _release(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        rows = sorted((int(r[0]), float(r[1])) for r in self.waiting.get())
        due = [r for r in rows if r[0] <= watermark_ms * 1000]
        if not due:
            return
        rest = rows[len(due):]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        n, seen, mean, m2, pos, neg = self.state.get() if self.state.exists() else (0, 0, 0.0, 0.0, 0.0, 0.0)
        out = []
        for us, x in due:
            seen += 1
            z = statistic = None
            alarm = False
            if np.isfinite(x):
                if n < self.warmup:
                    n += 1
                    step = x - mean
                    mean += step / n
                    m2 += step * (x - mean)
                else:
                    z = (x - mean) / ((m2 / n) ** 0.5 or 1.0)
                    pos, neg = max(0.0, pos + z - self.drift), max(0.0, neg - z - self.drift)
                    statistic = max(pos, neg)
                    alarm = statistic > self.threshold
                    if alarm:
                        pos = neg = 0.0
            out.append((key[0], us, x, statistic or 0.0, alarm, z, seen))
        self.state.update((n, seen, mean, m2, pos, neg))
        frame = pd.DataFrame(out, columns=["feature", TIME, "x", "statistic", "alert", "effect_size", "n_window"])
        frame[TIME] = pd.to_datetime(frame[TIME], unit="us")
        frame["effect_size"] = frame["effect_size"].astype(float)
        yield frame

    def close(self) -> None:
        pass


def cusum_stream(stream: DataFrame, features: Sequence[str], threshold: float = 5.0, drift: float = 0.5,
                 warmup: int = 100, delay: str = "10 minutes", block: str | None = None) -> DataFrame:
    """Streaming CUSUM per feature.

    ``block`` first averages each feature over fixed time blocks, so the ordered operator
    sees one row per block and feature and never the full event rate. Without it every
    observation passes through the one task of its feature.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = timed(stream, delay).select(TIME, *[F.col(f).cast("double").alias(f) for f in features])
    if block is not None:
        means = rows.groupBy(F.window(TIME, block).alias("w")).agg(*[F.avg(f).alias(f) for f in features])
        rows = means.select(F.window_time("w").alias(TIME), *features)
    long = rows.unpivot([TIME], list(features), "feature", "x")
    processor = CusumProcessor(threshold, drift, warmup)
    return long.groupBy("feature").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
