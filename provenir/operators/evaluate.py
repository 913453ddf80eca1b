"""Labelled time windows: candidates near a time, votes over thresholds, confusion matrix; and reports on two graphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import ProvGraph
from .ordered import count_below

#: Thresholds of the sweep: fixed values.
PSIS = (0.000001, 0.00001, 0.0001, 0.001, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def named_ends(graph: ProvGraph) -> DataFrame:
    """id, name, sec: named processes at either end of a timed edge, each second once."""
    names = graph.nodes.where("type = 'process' and name <> 'UNKNOWN'").select("id", "name")
    return graph.edges.where("sec is not null").select("sec", F.explode(F.array("src", "dst")).alias("id")).distinct().join(names, "id")


def candidates(graph: ProvGraph, labels: DataFrame, w: int, window: str = "symmetric") -> DataFrame:
    """label, id, name: processes with an edge in the label's window, each once.

    'symmetric': ts - w < time < ts + w, met in buckets of w seconds. 'prefix': w - ts < time < ts + w,
    which takes in everything before ts + w; a process then counts by its first such edge.
    """
    if window == "symmetric":
        ends = named_ends(graph).select("id", "name", "sec", F.floor(F.col("sec") / w).alias("b"))
        asked = labels.select(F.col("id").alias("label"), "ts", F.explode(F.array(*(F.floor(F.col("ts") / w) + k for k in (-1, 0, 1)))).alias("b"))
        return ends.join(asked, "b").where((F.col("sec") > F.col("ts") - w) & (F.col("sec") < F.col("ts") + w)).select("label", "id", "name").distinct()
    if window != "prefix":
        raise ValueError(window)
    ends = named_ends(graph)
    first = ends.groupBy("id", "name").agg(F.min("sec").alias("sec"), F.max("sec").alias("last"))
    span = first.agg(F.min("sec"), F.max("sec")).first()
    if span[0] is None:
        return first.select(F.lit(None).cast(labels.schema["id"].dataType).alias("label"), "id", "name").limit(0)
    low, width = span[0], max(1, (span[1] - span[0]) // 64 + 1)  # 64 coarse buckets: a label meets those up to its own
    place = lambda t: F.floor((t - low) / width)
    upto = F.least(place(F.col("ts") + w), F.lit(63).cast("long"))
    asked = labels.select(F.col("id").alias("label"), "ts", F.explode(F.when(upto >= 0, F.sequence(F.lit(0).cast("long"), upto))).alias("b"))
    met = first.select("id", "name", "sec", "last", place(F.col("sec")).alias("b")).join(asked, "b").where(F.col("sec") < F.col("ts") + w)
    # The lower bound only matters for labels before w: then an edge must lie between both.
    plain = met.where(F.col("sec") > w - F.col("ts")).select("label", "id", "name")
    rest = met.where((F.col("sec") <= w - F.col("ts")) & (F.col("last") > w - F.col("ts"))).select("label", "ts", "id", "name")
    late = rest.join(ends.select("id", F.col("sec").alias("t")), "id").where((F.col("t") > w - F.col("ts")) & (F.col("t") < F.col("ts") + w)).select("label", "id", "name")
    return plain.union(late).distinct()


def prefix_counts(graph: ProvGraph, labels: DataFrame, w: int, width: int = 86400) -> DataFrame:
    """label, n: how many processes candidates(..., "prefix") has for each label, by running counts instead of pairs.

    w - ts < time < ts + w says that time is less than ts away from w: a process counts by its edge nearest to w.
    """
    near = named_ends(graph).groupBy("id").agg(F.min(F.abs(F.col("sec") - w)).alias("t"))
    asked = labels.select(F.col("id").alias("label"), F.col("ts").alias("t"))
    return asked.join(count_below(near, asked, width), "t", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def decisions(found: DataFrame, preds: DataFrame, labels: DataFrame, psis: Sequence[float] = PSIS) -> DataFrame:
    """label, type, psi, normal, total, intrusions for each label and threshold; labels without candidates have zeros.

    preds: id, pred. One pass over the candidates serves all thresholds.
    """
    scored = found.join(preds.select("id", "pred"), "id").groupBy("label").agg(*(F.count_if(F.col("pred") > p).alias(f"n{k}") for k, p in enumerate(psis)), F.count("*").alias("total"))
    rows = F.array(*(F.struct(F.lit(float(p)).alias("psi"), F.coalesce(f"n{k}", F.lit(0)).alias("normal")) for k, p in enumerate(psis)))
    all_ = labels.select(F.col("id").alias("label"), "type").join(scored, "label", "left")
    total = F.coalesce("total", F.lit(0)).cast("long")
    return all_.select("label", "type", total.alias("total"), F.explode(rows).alias("r")).select("label", "type", "r.psi", F.col("r.normal").cast("long").alias("normal"), "total", (F.col("total") - F.col("r.normal")).cast("long").alias("intrusions"))


def confusion(decided: DataFrame, positive: str = "u2r", negative: str = "none", by: Sequence[str] = ()) -> DataFrame:
    """psi, tp, fn, fp, tn, tpr, fpr. A label is flagged if intrusions outnumber normal candidates. by: fields of label that come first and are told apart."""
    flag = F.col("intrusions") > F.col("normal")
    n = lambda kind, cond, name: F.count_if((F.col("type") == kind) & cond).cast("long").alias(name)
    keys = [F.col(f"label.{k}").alias(k) for k in by]
    counts = decided.groupBy(*keys, "psi").agg(n(positive, flag, "tp"), n(positive, ~flag, "fn"), n(negative, flag, "fp"), n(negative, ~flag, "tn"))
    rate = lambda a, b, name: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")).alias(name)
    return counts.select(*by, "psi", "tp", "fn", "fp", "tn", rate("tp", "fn", "tpr"), rate("fp", "tn", "fpr"))


def select_labels(labels: DataFrame, seed: int = 0) -> DataFrame:
    """All u2r rows, and twice as many none rows, chosen at random by the seed."""
    n = labels.where("type = 'u2r'").count()
    if not n or labels.where("type = 'none'").isEmpty():
        raise ValueError("labels of both types are needed")
    return labels.where("type = 'u2r'").union(labels.where("type = 'none'").orderBy(F.rand(seed)).limit(2 * n))


def window_sweep(graph: ProvGraph, labels: DataFrame, preds: DataFrame, widths: Sequence[int] = (10, 100, 1000), window: str = "symmetric") -> DataFrame:
    """w and the confusion matrix of each window width, all widths in one pass."""
    if window != "symmetric":
        parts = [confusion(decisions(candidates(graph, labels, w, window), preds, labels)).select(F.lit(w).alias("w"), "*") for w in widths]
        return reduce(DataFrame.union, parts)
    each = F.explode(F.array(*map(F.lit, widths))).alias("w")
    ends = named_ends(graph).select("id", "sec", each).select("id", "sec", "w", F.floor(F.col("sec") / F.col("w")).alias("b"))
    asked = labels.select(F.col("id").alias("label"), "ts", each).select("label", "ts", "w", F.explode(F.array(*(F.floor(F.col("ts") / F.col("w")) + k for k in (-1, 0, 1)))).alias("b"))
    found = ends.join(asked, ["w", "b"]).where((F.col("sec") > F.col("ts") - F.col("w")) & (F.col("sec") < F.col("ts") + F.col("w"))).select(F.struct("w", "label").alias("label"), "id").distinct()
    marks = labels.select("id", "type", each).select(F.struct("w", F.col("id").alias("label")).alias("id"), "type")
    return confusion(decisions(found, preds, marks), by=("w",))


def write_sweep(swept: DataFrame, folder: str) -> None:
    """The sweep's rows, in a folder for each width."""
    swept.write.mode("overwrite").partitionBy("w").parquet(folder)


def compare(good: DataFrame, bad: DataFrame) -> DataFrame:
    """stat, good, bad, difference: NULL where either side has none. Both: stat, density."""
    return good.select("stat", F.col("density").alias("good")).join(bad.select("stat", F.col("density").alias("bad")), "stat", "full").select("stat", "good", "bad", (F.col("good") - F.col("bad")).alias("difference"))
