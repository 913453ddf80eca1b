"""Audit events to a graph of process incarnations and file versions.

State that a reader of the log would carry (which process a pid names now, how often a path was
written) is a running sum over a window of the pid or the path. Input: events with seq (any orderable
value), kind (exit, fork, read, write, exec, rename), pid, child, path, path2, time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import basename, file_id, normal_path, process_id
from ..graph import ProvGraph
from .ordered import after

#: Event numbers by kind: fixed values of the audit format.
KINDS = {"exit": (1,), "fork": (2, 25, 241), "exec": (23,), "read": (72,), "write": tuple(range(73, 84)), "rename": (42,)}


def kind_of(event_id: Column) -> Column:
    """The kind of an event number, NULL for others."""
    return F.coalesce(*(F.when(event_id.isin(*ids), k) for k, ids in KINDS.items()))


def incarnations(events: DataFrame, rebind: bool = True) -> DataFrame:
    """seq, pid, child_row, incarnation: for each event its process, and for each fork also its child's (child_row).

    An exit ends an incarnation after itself. With rebind a fork opens a new one of its child's pid, at
    once: where an event forks its own pid, its own row already is in the new one.
    """
    own = events.select("seq", "pid", F.lit(1).alias("o"), (F.col("kind") == "exit").cast("int").alias("ends"))
    born = events.where("kind = 'fork' and child is not null").select("seq", F.col("child").alias("pid"), F.lit(0).alias("o"), F.lit(int(rebind)).alias("ends"))
    before = F.coalesce(F.sum("ends").over(Window.partitionBy("pid").orderBy("seq", "o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.union(born).select("seq", "pid", (F.col("o") == 0).alias("child_row"), (before + F.when(F.col("o") == 0, F.lit(int(rebind))).otherwise(0)).cast("long").alias("incarnation"))


def file_versions(uses: DataFrame, upsert: bool = False) -> DataFrame:
    """uses (seq, path, is_write, ...) with ordinal (the path's vertex: a write opens a new one, a read keeps it) and version (counts writes to real files only). upsert: one vertex for each path."""
    upto = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    write = F.col("is_write").cast("int")
    real = F.col("path").startswith("/") & ~F.col("path").startswith("/dev/")
    return uses.withColumn("version", F.sum(F.when(real, write).otherwise(0)).over(upto).cast("long")).withColumn("ordinal", F.lit(0).cast("long") if upsert else F.sum(write).over(upto).cast("long"))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """src, dst, type, operation, time: for each pair, the last of each that isn't NULL (by seq, then time)."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", "time", "type"))).alias(c)
    return edges.groupBy("src", "dst").agg(last("type"), last("operation"), last("time"))


def exec_names(events: DataFrame, where: DataFrame) -> DataFrame:
    """pid, incarnation, cmd: the path of the last exec of each incarnation."""
    own = where.where("not child_row").select("seq", "pid", "incarnation")
    return events.where("kind = 'exec' and path is not null").select("seq", "pid", "path").join(own, ["seq", "pid"]).groupBy("pid", "incarnation").agg(F.max_by("path", "seq").alias("cmd"))


def build(events: DataFrame, rebind: bool = True, upsert_files: bool = False) -> ProvGraph:
    """The graph of an event table. Edges go from child to parent and from process to file. seq must be unique."""
    where = incarnations(events, rebind)
    own = where.where("not child_row").select("seq", "incarnation")
    child = where.where("child_row").select("seq", F.col("incarnation").alias("child_incarnation"))
    placed = events.join(own, "seq").join(child, "seq", "left")
    me = process_id(F.col("pid"), F.col("incarnation"))
    forks = placed.where("kind = 'fork' and child is not null").select("seq", process_id(F.col("child"), F.col("child_incarnation")).alias("src"), me.alias("dst"), F.lit("triggered by").alias("type"), F.lit("fork").alias("operation"), "time")
    target = F.coalesce("path2", "path")
    plain = placed.where("kind in ('read', 'write')").select("seq", "time", me.alias("me"), normal_path(target).alias("path"), (F.col("kind") == "write").alias("is_write"), F.lit(False).alias("renamed"))
    moved = placed.where("kind = 'rename' and path is not null and path2 is not null")
    source = moved.select("seq", "time", me.alias("me"), normal_path(F.col("path")).alias("path"), F.lit(False).alias("is_write"), F.lit(True).alias("renamed"))
    goal = moved.select("seq", "time", me.alias("me"), normal_path(F.col("path2")).alias("path"), F.lit(True).alias("is_write"), F.lit(True).alias("renamed"))
    uses = file_versions(plain.union(source).union(goal).where("path is not null"), upsert_files).withColumn("file", file_id(F.col("path"), F.col("ordinal")))
    touches = uses.select("seq", F.col("me").alias("src"), F.col("file").alias("dst"), F.when(F.col("is_write"), "generated").otherwise("used").alias("type"), F.lit(None).cast("string").alias("operation"), "time")
    renames = uses.where("renamed")
    derived = renames.where("is_write").select("seq", "time", F.col("file").alias("src")).join(renames.where("not is_write").select("seq", F.col("file").alias("dst")), "seq").select("seq", "src", "dst", F.lit("derived").alias("type"), F.lit("rename").alias("operation"), "time")
    edges = upsert_edges(forks.union(touches).union(derived))
    processes = where.select("pid", "incarnation").distinct().join(exec_names(events, where), ["pid", "incarnation"], "left").select(process_id(F.col("pid"), F.col("incarnation")).alias("id"), F.lit("process").alias("type"), F.col("cmd").alias("name"), F.col("pid").cast("string").alias("pid"), "incarnation", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("version"))
    files = uses.groupBy("file", "path").agg(F.max("version").alias("version")).select(F.col("file").alias("id"), F.lit("file").alias("type"), basename(F.col("path")).alias("name"), F.lit(None).cast("string").alias("pid"), F.lit(None).cast("long").alias("incarnation"), "path", "version")
    return ProvGraph(processes.union(files), edges)


def parent_edges(graph: ProvGraph, snapshot: DataFrame) -> DataFrame:
    """src, dst, type, operation, time: untimed edges from a process to its parent (pid, ppid of a snapshot), between last incarnations that the graph has."""
    last = graph.nodes.where("type = 'process'").groupBy("pid").agg(F.max_by("id", "incarnation").alias("id"))
    named = snapshot.select("pid", "ppid").join(last.withColumnRenamed("id", "src"), "pid").join(last.select(F.col("pid").alias("ppid"), F.col("id").alias("dst")), "ppid")
    return named.select("src", "dst", F.lit("triggered by").alias("type"), F.lit(None).cast("string").alias("operation"), F.lit(None).cast("long").alias("time"))


def snapshot_as_of(events: DataFrame, batches: DataFrame, width: int) -> DataFrame:
    """events (ts in seconds) with `batch`: the first of batches (batch, end_ts) that ends at ts or later; NULL after the last.

    The search is within buckets of `width` seconds; an event whose bucket has no later end takes the
    first end of the next bucket that has one. That is found within spans of buckets, and
    beyond a span from the first ends of all spans (see ordered.after). Rows are read backwards: a frame
    that ends at the row is carried along, one that starts at it is read anew for each row.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    ends = batches.where("end_ts is not null").select(bucket("end_ts").alias("b"), F.col("end_ts").alias("t"), F.lit(1).alias("o"), F.struct("end_ts", "batch").alias("end"))
    rows = events.withColumn("__row", F.struct(*events.columns)).select(bucket("ts").alias("b"), F.col("ts").alias("t"), F.lit(0).alias("o"), "__row")
    both = rows.withColumn("end", F.lit(None).cast(ends.schema["end"].dataType)).unionByName(ends.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)))
    backwards = Window.partitionBy("b").orderBy(F.desc("t"), F.desc("o"), F.desc("end"))
    ahead = F.last("end", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    firsts = both.groupBy("b").agg(F.min("end").alias("first"))  # a row for each bucket
    later = after(firsts)
    found = both.withColumn("own", ahead).where("__row is not null").join(later, "b", "left")
    return found.select("__row.*", F.coalesce("own", "after")["batch"].alias("batch"))
