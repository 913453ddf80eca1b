"""Ordered tables at any size: what lies before or after a place, by buckets and spans of buckets instead of one sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a span.
SPAN = 1024


def before(buckets: DataFrame) -> DataFrame:
    """`b`, `sum`: the sum of `n` over the buckets (b, n) before each. Windows run within spans, and over the spans' totals."""
    spans = buckets.select("b", "n", F.floor(F.col("b") / SPAN).alias("span"))
    inside = F.sum("n").over(Window.partitionBy("span").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    total = spans.groupBy("span").agg(F.sum("n").alias("n"))
    past = total.select("span", F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("past"))
    return spans.withColumn("inside", inside).join(past, "span").select("b", (F.coalesce("inside", F.lit(0)) + F.coalesce("past", F.lit(0))).alias("sum"))


def after(buckets: DataFrame) -> DataFrame:
    """`b`, `after`: the first value of `first` that isn't NULL in the buckets (b, first) after each. Read backwards, so that frames are carried along."""
    spans = buckets.select("b", "first", F.floor(F.col("b") / SPAN).alias("span"))
    ahead = lambda w: F.last("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tops = spans.groupBy("span").agg(F.min("first").alias("first"))
    beyond = tops.select("span", ahead(Window.orderBy(F.desc("span"))).alias("beyond"))
    return spans.withColumn("own", ahead(Window.partitionBy("span").orderBy(F.desc("b")))).join(beyond, "span").select("b", F.coalesce("own", "beyond").alias("after"))


def count_below(points: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """`t`, `n`: for each distinct t of asked, how many points (whole numbers t) are less. Buckets are `width` wide and hold each t once."""
    bucket: Column = F.floor(F.col("t") / width).alias("b")
    counted = points.groupBy("t").agg(F.count("*").alias("n")).select(bucket, "t", F.lit(1).alias("o"), "n")
    wanted = asked.select("t").distinct().select(bucket, "t", F.lit(0).alias("o"), F.lit(0).cast("long").alias("n"))
    both = counted.union(wanted)
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    past = before(both.groupBy("b").agg(F.sum("n").alias("n")))
    return both.withColumn("inside", inside).where("o = 0").join(past, "b").select("t", (F.col("inside") + F.col("sum")).alias("n"))
