"""Categories whose levels stay a table."""

from pyspark.sql import functions as F

from tidewatch.operators import preprocess
from tidewatch.session import ROWS_PER_SLICE_KEY


def test_joined_levels_give_the_vectors_of_collected_ones(spark):
    df = spark.range(400).select(F.when(F.col("id") % 9 > 0, F.col("id") % 130).cast("string").alias("c"), (F.col("id") % 5).cast("double").alias("x"), "id")
    train = df.where("id < 100")
    both = preprocess.fit_features(train, ["x"], ["c"])
    want = {r.id: r.features.toArray().tolist() for r in both.vectors(df).collect()}
    spark.conf.set(ROWS_PER_SLICE_KEY, "20")
    try:
        table = preprocess.fit_level_table(train, "c")
        got = {r.id: r.features.toArray().tolist() for r in table.vectors(df, preprocess.fit_features(train, ["x"])).collect()}
    finally:
        spark.conf.unset(ROWS_PER_SLICE_KEY)
    assert got == want and table.size == len(both.levels["c"])
