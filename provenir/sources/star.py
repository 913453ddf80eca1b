"""Two graphs over the driver's tables: a kernel-provenance one of the star schema, an audit one of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import ProvGraph
from ..operators import audit_graph
from ..session import checkpointed


def seconds(column: str):
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the one before of the same customer and their rank."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", (F.row_number().over(w) - 1).alias("rank"), F.lag("o_orderkey").over(w).alias("previous"))


def kernel_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pnode, version, type, name, freeze_sec, freeze_nsec."""
    none = F.lit(None)

    def rows(df, letter, k, pnode, version, kind, name, sec=none, nsec=none):
        return df.select(key(letter, k).alias("id"), pnode.cast("string").alias("pnode"), version.cast("long").alias("version"), F.lit(kind).alias("type"), name.cast("string").alias("name"), sec.cast("long").alias("freeze_sec"), nsec.cast("long").alias("freeze_nsec"))

    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    n, p, o = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part"), ordered(spark, sf_dir)
    named = s.join(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "left")
    zero = F.lit(0)
    return (
        rows(c, "C", "c_custkey", F.concat(F.lit("C"), F.floor(F.col("c_custkey") / 2).cast("string")), F.col("c_custkey") % 2, "PROC", F.col("c_mktsegment"))
        .union(rows(named, "S", "s_suppkey", key("S", "s_suppkey"), zero, "PROC", F.col("n_name")))
        .union(rows(o, "O", "o_orderkey", key("O", "o_custkey"), F.col("rank"), "FILE", F.col("o_orderpriority"), seconds("o_orderdate"), F.col("o_orderkey") % 1000))
        .union(rows(p, "P", "p_partkey", key("P", "p_partkey"), zero, "FILE", F.col("p_brand")))
        .union(rows(n, "N", "n_nationkey", F.col("n_nationkey").cast("string"), zero, "PIPE", F.format_string("PIPE-(%d, 0)", F.col("n_nationkey").cast("long"))))
    )


def kernel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type; no pair twice."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    o, li = ordered(spark, sf_dir), table(spark, sf_dir, "lineitem")

    def edges(df, a, b, kind):
        return df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))

    known = c.select(F.col("c_custkey").alias("k"))
    forks = c.where("c_custkey >= 10").select("c_custkey", F.floor(F.col("c_custkey") / 10).alias("k")).join(known, "k", "left_semi")
    twins = c.where("c_custkey % 2 = 1").select("c_custkey", (F.col("c_custkey") - 1).alias("k")).join(known, "k", "left_semi")
    return (
        edges(o.join(known.withColumnRenamed("k", "o_custkey"), "o_custkey", "left_semi"), key("C", "o_custkey"), key("O", "o_orderkey"), "INPUT")
        .union(edges(li, key("O", "l_orderkey"), key("P", "l_partkey"), "INPUT").distinct())
        .union(edges(li, key("P", "l_partkey"), key("S", "l_suppkey"), "INPUT").distinct())
        .union(edges(c, key("C", "c_custkey"), key("N", "c_nationkey"), "INPUT"))
        .union(edges(s, key("N", "s_nationkey"), key("S", "s_suppkey"), "INPUT"))
        .union(edges(forks, key("C", "k"), key("C", "c_custkey"), "FORKPARENT"))
        .union(edges(twins, key("C", "k"), key("C", "c_custkey"), "VERSION"))
        .union(edges(o.where("previous is not null"), key("O", "previous"), key("O", "o_orderkey"), "VERSION"))
    )


def kernel_graph(spark: SparkSession, sf_dir: str) -> ProvGraph:
    return ProvGraph(kernel_nodes(spark, sf_dir), kernel_edges(spark, sf_dir))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, kind, pid, child, path, path2, time (seconds): one row for each event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kinds = F.create_map(*(F.lit(x) for p in (("error", "exit"), ("signup", "fork"), ("view", "read"), ("click", "write"), ("purchase", "exec")) for x in p))
    kind = F.element_at(kinds, F.col("event_type"))
    path = F.when(kind.isin("read", "write"), F.concat(F.lit("/f"), k.cast("string"))).when(kind == "exec", F.concat(F.lit("/bin/p"), (k % 10).cast("string")))
    return e.select(F.struct("ts", "event_id").alias("seq"), kind.alias("kind"), F.col("user_id").alias("pid"), F.when(kind == "fork", k).alias("child"), path.alias("path"), F.lit(None).cast("string").alias("path2"), seconds("ts").alias("time"), "event_id", "ts")


def audit_graph_of(spark: SparkSession, sf_dir: str) -> ProvGraph:
    """The events' graph without isolated nodes, UNKNOWN for unnamed processes; edges have sec. Computed once: windows and upserts don't run again for each use."""
    made = audit_graph.build(audit_events(spark, sf_dir))
    edges = checkpointed(made.edges.withColumn("sec", F.col("time")))
    own = ProvGraph(made.nodes, edges).drop_isolated().unknown_names()
    return ProvGraph(checkpointed(own.nodes), edges)


def intrusion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, type: every 200th event is u2r, a series between is none."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 200 == 0, "u2r").when(F.col("event_id") % 100 == 50, "none")
    return e.select(F.col("event_id").alias("id"), seconds("ts").alias("ts"), kind.alias("type")).where("type is not null")
