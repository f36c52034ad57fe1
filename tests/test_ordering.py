import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.operators.ordering import chunked_lag, global_rank, running_sums

from .conftest import rows


def test_global_rank_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v"), F.col("id")).repartition(9)
    got = dict(rows(global_rank(df, [F.col("v").desc(), F.col("id")], partitions=6), "id", "rank"))
    want = dict(rows(df.withColumn("r", F.row_number().over(Window.orderBy(F.col("v").desc(), "id"))), "id", "r"))
    assert got == want


def test_running_sums_and_lag_match_plain_windows(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(k, t0 + dt.timedelta(seconds=37 * i + k), i % 3 == 0) for k in range(3) for i in range(400)]
    df = spark.createDataFrame(data, "k long, ts timestamp, f boolean").repartition(5)
    ch = F.date_trunc("minute", "ts")
    got = running_sums(df, ["k"], ["ts"], ch, {"c": F.col("f").cast("int"), "i": F.lit(1)})
    w = Window.partitionBy("k").orderBy("ts")
    want = df.withColumn("c", F.sum(F.col("f").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))) \
             .withColumn("i", F.row_number().over(w))
    assert sorted(rows(got, "k", "ts", "c", "i")) == sorted(rows(want, "k", "ts", "c", "i"))
    lg = chunked_lag(df.withColumn("x", F.col("ts").cast("string")), ["k"], ["ts"], ch, ["x"])
    want = df.withColumn("prev_x", F.lag(F.col("ts").cast("string")).over(w))
    assert sorted(rows(lg, "k", "ts", "prev_x")) == sorted(rows(want, "k", "ts", "prev_x"))
