"""Typed-edge statistics: for each node, how many neighbours of a type lie over edges of a type."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import ProvGraph


class Stat(NamedTuple):
    own: str
    direction: str
    edge: str
    other: str


#: The sixteen statistics, whose names are fixed values; adding an entry adds a statistic.
STATS: dict[str, Stat] = {
    "file_out_file": Stat("FILE", "out", "INPUT", "FILE"),
    "file_in_file": Stat("FILE", "in", "INPUT", "FILE"),
    "file_out_proc": Stat("FILE", "out", "INPUT", "PROC"),
    "file_in_proc": Stat("FILE", "in", "INPUT", "PROC"),
    "proc_out_file": Stat("PROC", "out", "INPUT", "FILE"),
    "proc_in_file": Stat("PROC", "in", "INPUT", "FILE"),
    "proc_out_proc": Stat("PROC", "out", "FORKPARENT", "PROC"),
    "proc_in_proc": Stat("PROC", "in", "FORKPARENT", "PROC"),
    "proc_in_version": Stat("PROC", "in", "VERSION", "PROC"),
    "proc_out_version": Stat("PROC", "out", "VERSION", "PROC"),
    "file_in_version": Stat("FILE", "in", "VERSION", "FILE"),
    "file_out_version": Stat("FILE", "out", "VERSION", "FILE"),
    "pipe_out_proc": Stat("PIPE", "out", "INPUT", "PROC"),
    "pipe_in_proc": Stat("PIPE", "in", "INPUT", "PROC"),
    "proc_out_pipe": Stat("PROC", "out", "INPUT", "PIPE"),
    "proc_in_pipe": Stat("PROC", "in", "INPUT", "PIPE"),
}


def incidences(graph: ProvGraph) -> DataFrame:
    """id, direction, edge, other: every typed edge seen from both of its ends. Untyped edges and neighbours match nothing."""
    kinds = graph.nodes.select("id", "type").where("type is not null")
    typed = graph.edges.where("type is not null").select("src", "dst", F.col("type").alias("edge"))
    both = typed.join(kinds.select(F.col("id").alias("src"), F.col("type").alias("s")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("type").alias("d")), "dst")
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("d").alias("other")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("s").alias("other")))
    return both.select("edge", F.explode(ends).alias("e")).select("e.id", "e.direction", "edge", "e.other")


def all_stats(graph: ProvGraph, stats: dict[str, Stat] = STATS) -> DataFrame:
    """id, type, name and a count for each statistic, from one pass over the edges; 0 where nothing matches or the type differs."""

    def met(s: Stat):
        return F.count_if((F.col("direction") == s.direction) & (F.col("edge") == s.edge) & (F.col("other") == s.other))

    sums = incidences(graph).groupBy("id").agg(*(met(s).alias(k) for k, s in stats.items()))
    counts = (F.when(F.col("type") == s.own, F.coalesce(k, F.lit(0))).otherwise(0).cast("long").alias(k) for k, s in stats.items())
    return graph.nodes.select("id", "type", "name").join(sums, "id", "left").select("id", "type", "name", *counts)


def count_edge_types(graph: ProvGraph, stat: Stat) -> DataFrame:
    """id, name, cnt for each node of the statistic's own type, zeros included."""
    kinds = graph.nodes.select("id", "type")
    near, far = ("src", "dst") if stat.direction == "out" else ("dst", "src")
    others = kinds.where(F.col("type") == stat.other).select(F.col("id").alias(far))
    counts = graph.edges.where(F.col("type") == stat.edge).join(others, far, "left_semi").groupBy(F.col(near).alias("id")).agg(F.count("*").alias("cnt"))
    own = graph.nodes.where(F.col("type") == stat.own).select("id", "name")
    return own.join(counts, "id", "left").select("id", "name", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def samples(graph: ProvGraph, stats: dict[str, Stat] = STATS) -> DataFrame:
    """id, name, stat, value: a row for each node and each statistic of its type."""
    if len(stats) == 1:  # no need of both ends' types
        ((name, stat),) = stats.items()
        return count_edge_types(graph, stat).select("id", "name", F.lit(name).alias("stat"), F.col("cnt").cast("double").alias("value"))
    wide = all_stats(graph, stats)
    rows = F.array(*(F.struct(F.lit(k).alias("stat"), F.lit(s.own).alias("own"), F.col(k).cast("double").alias("value")) for k, s in stats.items()))
    return wide.select("id", "name", F.explode(F.filter(rows, lambda r: r["own"] == F.col("type"))).alias("r")).select("id", "name", "r.stat", "r.value")


def node_values(graph: ProvGraph, nodes: DataFrame, stats: dict[str, Stat] = STATS) -> DataFrame:
    """id, name, stat, value: every statistic of each node in `nodes` (column id), 0 for those of other types. Only edges that touch them are read on."""
    ids = nodes.select("id").distinct()
    near = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(graph.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")).distinct()
    wide = all_stats(ProvGraph(graph.nodes, near), stats).join(ids, "id", "left_semi")
    rows = F.array(*(F.struct(F.lit(k).alias("stat"), F.col(k).alias("value")) for k in stats))
    return wide.select("id", "name", F.explode(rows).alias("r")).select("id", "name", "r.stat", "r.value")


def by_name(rows: DataFrame) -> DataFrame:
    """name, stat, n, sum, mean, min, max of sample rows."""
    return rows.groupBy("name", "stat").agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
