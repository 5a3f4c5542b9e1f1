import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelforge.operators.running import running_sums


def test_running_sums_equal_plain_window_with_hot_key(spark):
    rnd = random.Random(7)
    t0 = dt.datetime(2026, 1, 1)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else f"k{rnd.randint(0, 9)}"  # one key holds two thirds of the rows
        rows.append((key, t0 + dt.timedelta(minutes=rnd.randint(0, 3000)), i, rnd.randint(0, 50)))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, sid long, v long")
    order = [F.col("ts").asc(), F.col("sid").asc()]
    got = running_sums(df, ["k"], order, {"cum": F.col("v"), "n": F.lit(1)}, F.date_trunc("hour", F.col("ts")))
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("sid", F.sum("v").over(w).alias("cum"), F.count(F.lit(1)).over(w).alias("n"))
    a = sorted(tuple(r) for r in got.select("sid", "cum", "n").collect())
    b = sorted(tuple(r) for r in want.collect())
    assert a == b and len(a) == 600
