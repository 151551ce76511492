import pytest
from pyspark.sql import functions as F

from tidewatch.operators import split


def axis(spark, n=2000, per=1):
    return spark.sql(f"SELECT id, timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0, floor(id/{per})*7.25) AS timestamp, int(id % 3 = 0) AS label FROM range({n})")


def test_periods_are_complete_ordered_and_disjoint(spark):
    df = axis(spark)
    cuts = split.find_cuts(df)
    parts = {p: cuts.period(df, p) for p in cuts.names}
    assert sum(p.count() for p in parts.values()) == 2000
    summary = split.period_summary(cuts.label(df))
    assert summary.count() == 4 and split.order_violations(summary).isEmpty()
    split.require_ordered(summary)
    assert {r.period: r.row_count for r in summary.collect()} == {"train": 1000, "validation": 300, "backtest": 300, "forward": 400}


def test_equal_timestamps_stay_together(spark):
    df = axis(spark, per=130)
    labelled = split.find_cuts(df).label(df)
    assert labelled.groupBy("timestamp").agg(F.count_distinct("period").alias("n")).where("n > 1").isEmpty()
    # 1,000 lies inside a run of 130 equal timestamps: the run goes to the earlier period.
    assert labelled.where("period = 'train'").count() == 1040


def test_hot_timestamp_and_impossible_splits(spark):
    hot = axis(spark).withColumn("timestamp", F.when(F.col("id").between(600, 1270), F.lit("2024-01-01 01:20:00").cast("timestamp_ntz")).otherwise(F.col("timestamp")))
    labelled = split.find_cuts(hot).label(hot)
    assert labelled.groupBy("timestamp").agg(F.count_distinct("period").alias("n")).where("n > 1").isEmpty()
    with pytest.raises(ValueError, match="sum to 1"):
        split.find_cuts(axis(spark), train=0.9)
    with pytest.raises(ValueError, match="separate"):
        split.find_cuts(axis(spark).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz")))
    with pytest.raises(ValueError, match="no usable rows"):
        split.find_cuts(axis(spark).where("false"))


def test_absent_period_and_leakage(spark):
    df = axis(spark)
    cuts = split.find_cuts(df, use_forward=False)
    assert cuts.names == ("train", "validation", "backtest")
    with pytest.raises(split.TemporalLeakageError):
        cuts.period(df, "forward")
    with pytest.raises(split.TemporalLeakageError):
        split.require_no_later_rows(df, cuts.bounds("train")[1])
    split.require_no_later_rows(cuts.period(df, "train"), cuts.bounds("train")[1])


def test_period_filter_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumnRenamed("ts", "timestamp")
    cuts = split.find_cuts(events)
    plan = cuts.period(events, "backtest").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts," in plan and "LessThanOrEqual(ts," in plan
