"""Centralities: degrees and age by aggregation, reachability by frontiers, spectral ones by iteration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import ProvGraph
from ..session import checkpointed

#: Rounds between checkpoints of an iteration.
EVERY = 5


def degree(graph: ProvGraph, direction: str = "in") -> DataFrame:
    """id, value: degree / (number of nodes - 1)."""
    n = graph.nodes.count()
    end = "dst" if direction == "in" else "src"
    counts = graph.edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("k"))
    return graph.nodes.select("id").join(counts, "id", "left").select("id", F.try_divide(F.coalesce("k", F.lit(0)).cast("double"), F.lit(float(n - 1))).alias("value"))


def distances(graph: ProvGraph, sources: DataFrame | None = None, hops: int | None = None) -> DataFrame:
    """source, node, d: the least number of edges from each source to each node that it reaches, itself left out.

    One frontier join for each distance, with what was reached before taken away; each is written to
    the checkpoint folder, and the loop ends with an empty frontier. sources: ids in column id (all nodes by default).
    """
    start = (sources if sources is not None else graph.nodes).select(F.col("id").alias("source"), F.col("id").alias("node")).distinct()
    links = checkpointed(graph.edges.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    seen = checkpointed(start.withColumn("d", F.lit(0)))
    frontier, d = seen, 0
    while hops is None or d < hops:
        d += 1
        ahead = frontier.join(links, "node").select("source", F.col("next").alias("node")).distinct()
        frontier = checkpointed(ahead.join(seen, ["source", "node"], "left_anti").withColumn("d", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if d % EVERY == 0:
            seen = checkpointed(seen)
    return seen.where("d > 0")


def ancestor(graph: ProvGraph, sources: DataFrame | None = None, reached: DataFrame | None = None) -> DataFrame:
    """id, value: share of all nodes that the node reaches."""
    n = graph.nodes.count()
    counts = (reached if reached is not None else distances(graph, sources)).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("k"))
    own = (sources if sources is not None else graph.nodes).select("id").distinct()
    return own.join(counts, "id", "left").select("id", (F.coalesce("k", F.lit(0)) / float(max(n, 1))).alias("value"))


def opsahl(graph: ProvGraph, sources: DataFrame | None = None, reached: DataFrame | None = None) -> DataFrame:
    """id, value: sum of 1 / distance over the nodes that the node reaches, to 12 places, so that sums of the same distances are equal in any order."""
    sums = (reached if reached is not None else distances(graph, sources)).groupBy(F.col("source").alias("id")).agg(F.sum(1.0 / F.col("d")).alias("s"))
    own = (sources if sources is not None else graph.nodes).select("id").distinct()
    return own.join(sums, "id", "left").select("id", F.round(F.coalesce("s", F.lit(0.0)), 12).alias("value"))


def age(graph: ProvGraph, padded: bool = False) -> DataFrame:
    """id, value: freeze time scaled from 0 to 1; 0 for nodes without one.

    The time is the number written as seconds, a point and nanoseconds, which aren't padded unless asked for.
    """
    nsec = F.col("freeze_nsec").cast("string")
    time = F.concat(F.col("freeze_sec").cast("string"), F.lit("."), F.lpad(nsec, 9, "0") if padded else nsec).cast("double")
    timed = graph.nodes.select("id", time.alias("t"))
    low, high = timed.agg(F.min("t"), F.max("t")).first()
    scaled = F.try_divide(F.col("t") - F.lit(low), F.lit(None if low is None else high - low).cast("double"))
    return timed.select("id", F.when(F.col("t").isNull() | (F.col("t") == 0), 0.0).otherwise(scaled).alias("value"))


def pagerank(graph: ProvGraph, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-10) -> DataFrame:
    """id, value: power iteration; what dangling nodes hold is spread evenly. Sums to 1."""
    n = graph.nodes.count()
    links = graph.edges.select("src", "dst").distinct()
    share = checkpointed(links.join(links.groupBy("src").agg(F.count("*").alias("out")), "src"))
    nodes = checkpointed(graph.nodes.select("id").join(share.select(F.col("src").alias("id"), F.lit(True).alias("sends")).distinct(), "id", "left"))
    rank = nodes.select("id", "sends", F.lit(1.0 / max(n, 1)).alias("value"))
    dangling = nodes.where("sends is null").count() / max(n, 1)
    for k in range(1, rounds + 1):
        got = share.join(rank.select(F.col("id").alias("src"), "value"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("value") / F.col("out")).alias("got"))
        new = nodes.join(got, "id", "left").select("id", "sends", (F.lit((1 - damping) / max(n, 1) + damping * dangling / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("value"))
        held = Observation()  # of the job that writes the round
        new = checkpointed(new.observe(held, F.coalesce(F.sum(F.when(F.col("sends").isNull(), F.col("value"))), F.lit(0.0)).alias("dangling")))
        dangling = held.get["dangling"]
        if tolerance is not None and k % EVERY == 0:
            moved = new.join(rank.select("id", F.col("value").alias("old")), "id").agg(F.coalesce(F.sum(F.abs(F.col("value") - F.col("old"))), F.lit(0.0))).first()[0]
            rank = new
            if moved < tolerance * max(n, 1):
                break
        rank = new
    return rank.select("id", "value")


def eigenvector(graph: ProvGraph, rounds: int = 100, side: str = "right") -> DataFrame:
    """id, value: dominant eigenvector by power iteration, of length 1 and not negative.

    The matrix has 1 for an edge, and 1 / number of nodes along the row of a node without outgoing
    edges. side 'right' sums over a node's targets, 'left' over its sources. Where the dominant
    eigenvalue isn't unique, the result depends on rounds.
    """
    if side not in ("right", "left"):
        raise ValueError(side)
    n = graph.nodes.count()
    near, far = ("src", "dst") if side == "right" else ("dst", "src")
    links = checkpointed(graph.edges.select("src", "dst").distinct())
    senders = links.select(F.col("src").alias("id"), F.lit(True).alias("sends")).distinct()
    nodes = checkpointed(graph.nodes.select("id").join(senders, "id", "left"))
    x = nodes.select("id", "sends", F.lit(1.0).alias("value"))
    total, length, loose = float(n), math.sqrt(n), float(nodes.where("sends is null").count())
    for _ in range(rounds):
        if not length:
            break
        got = links.join(x.select(F.col("id").alias(far), "value"), far).groupBy(F.col(near).alias("id")).agg(F.sum("value").alias("got"))
        joined = nodes.join(got, "id", "left")
        if side == "right":
            value = F.when(F.col("sends").isNull(), F.lit(total / n)).otherwise(F.coalesce("got", F.lit(0.0)))
        else:
            value = F.coalesce("got", F.lit(0.0)) + loose / n
        held = Observation()
        sums = (F.coalesce(c, F.lit(0.0)).alias(k) for k, c in (("total", F.sum("value")), ("square", F.sum(F.col("value") * F.col("value"))), ("loose", F.sum(F.when(F.col("sends").isNull(), F.col("value"))))))
        x = checkpointed(joined.select("id", "sends", (value / length).alias("value")).observe(held, *sums))
        total, length, loose = held.get["total"], math.sqrt(held.get["square"]), held.get["loose"]
    return x.select("id", (F.col("value") / (length or 1.0)).alias("value"))
