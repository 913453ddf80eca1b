"""Nonparametric densities of groups and scores under them. A model is the table of its samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import gaussian

BANDWIDTH = 0.5
#: Places to which log-likelihoods are rounded before they are ranked, so that symmetric values tie.
PLACES = 12
#: Distinct values of a group that are scored in one part.
PART = 2000


def model(samples: DataFrame) -> DataFrame:
    """name, stat, value, cnt: the samples with equal values counted once."""
    return samples.groupBy("name", "stat", "value").agg(F.count("*").alias("cnt"))


def met_in_parts(asked: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """asked joined with near on keys. A group's asked rows are dealt to as many parts as it has PART of them, and its near rows go to all, so that a large group isn't one task."""
    parts = asked.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("__parts")).where("__parts > 1")
    if parts.isEmpty():
        return asked.join(near, keys)
    dealt = asked.join(parts, keys, "left").withColumn("__part", F.pmod(F.xxhash64("value"), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    spread = near.join(parts, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(spread, [*keys, "__part"]).drop("__part")


def kde_score(queries: DataFrame, samples: DataFrame, bandwidth: float = BANDWIDTH, model_name: str | None = None) -> DataFrame:
    """queries (name, stat, value, ...) with `density` under the samples of their name, NULL where there are none.

    Equal samples and equal queries are met once: the join has distinct values on both sides.
    model_name: score every query under that name's samples.
    """
    own = queries.withColumn("__model", F.lit(model_name) if model_name else F.col("name"))
    asked = own.select("__model", "stat", "value").distinct()
    near = model(samples).select(F.col("name").alias("__model"), "stat", F.col("value").alias("x"), "cnt")
    part = F.exp(-F.pow(F.col("value") - F.col("x"), F.lit(2.0)) / (2 * bandwidth**2))
    met = met_in_parts(asked, near, ["__model", "stat"]).groupBy("__model", "stat", "value").agg((F.sum(F.col("cnt") * part) / F.sum("cnt") / (bandwidth * math.sqrt(2 * math.pi))).alias("density"))
    return own.join(met, ["__model", "stat", "value"], "left").drop("__model")


def minimum_by_stat(scored: DataFrame) -> DataFrame:
    """name, stat, density, id: the least density and the smallest node that has it."""
    return scored.where("density is not null").groupBy("name", "stat").agg(F.min(F.struct("density", "id")).alias("m")).select("name", "stat", F.col("m.density").alias("density"), F.col("m.id").alias("id"))


def parzen(values: DataFrame) -> DataFrame:
    """name, metric, value, cnt, n, sigma, ll: log-likelihood of each distinct value under its group, by Gaussians of the group's population deviation.

    A constant group has sigma 0 and no likelihood.
    """
    grouped = values.groupBy("name", "metric", "value").agg(F.count("*").alias("cnt"))
    groups = values.groupBy("name", "metric").agg(F.count("*").alias("n"), F.when(F.min("value") == F.max("value"), 0.0).otherwise(F.stddev_pop("value")).alias("sigma"))
    own = grouped.join(groups, ["name", "metric"])
    others = grouped.select("name", "metric", F.col("value").alias("x"), F.col("cnt").alias("c"))
    sums = met_in_parts(own.where("sigma > 0"), others, ["name", "metric"]).groupBy("name", "metric", "value").agg(F.ln(F.sum(F.col("c") * gaussian(F.col("value"), F.col("x"), F.col("sigma"))) / F.first("n")).alias("ll"))
    return own.join(sums, ["name", "metric", "value"], "left")


def parzen_pred(table: DataFrame, rank: str = "strict") -> DataFrame:
    """The parzen table with `pred`: the share of the group's values that are less likely ('strict'), or at most as likely ('cume').

    Values of a constant group have pred 0. Windows run over distinct values.
    """
    if rank not in ("strict", "cume"):
        raise ValueError(rank)
    ranked = table.withColumn("__ll", F.round("ll", PLACES))
    up = F.sum("cnt").over(Window.partitionBy("name", "metric").orderBy("__ll").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum("cnt").over(Window.partitionBy("name", "metric", "__ll"))
    below = up if rank == "cume" else up - ties
    return ranked.withColumn("pred", F.when(F.col("sigma") > 0, below / F.col("n")).otherwise(F.lit(0.0))).drop("__ll")


def histogram(samples: DataFrame, bins: int = 10) -> DataFrame:
    """name, stat, bin (from 1), lo, hi, cnt: equal bins from least to greatest value, the last one closed; a constant group has 3 bins of width 2/3 about its value. Empty bins are left out."""
    span = samples.groupBy("name", "stat").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    flat = F.col("a") == F.col("b")
    span = span.select("name", "stat", F.when(flat, F.col("a") - 1).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 1).otherwise(F.col("b")).alias("b"), F.when(flat, 3).otherwise(bins).alias("k"))
    width = (F.col("b") - F.col("a")) / F.col("k")
    placed = model(samples).join(span, ["name", "stat"]).withColumn("bin", F.least(F.floor((F.col("value") - F.col("a")) / width).cast("int") + 1, F.col("k")))
    return placed.groupBy("name", "stat", "bin", "a", "b", "k").agg(F.sum("cnt").alias("cnt")).select("name", "stat", "bin", (F.col("a") + (F.col("bin") - 1) * width).alias("lo"), (F.col("a") + F.col("bin") * width).alias("hi"), "cnt")


def grid(samples: DataFrame, points: int = 100, bandwidth: float = BANDWIDTH) -> DataFrame:
    """name, stat, i, value, density: the curve at evenly spaced points between the group's least and greatest values."""
    span = samples.groupBy("name", "stat").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    at = span.select("name", "stat", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select("name", "stat", "i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1)).alias("value"))
    return kde_score(at, samples, bandwidth)
