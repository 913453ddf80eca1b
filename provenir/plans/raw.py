"""Raw inputs made of the driver's tables, and the queries that read them back.

Customers become a kernel database (binary keys and values: two customers are versions of one object, every
tenth one forks, orders are inputs), events become audit text, name snapshots, process listings and label
lists. What the sources and the graph construction make of them is compared with SQL over the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import ProvGraph
from ..operators import audit_graph, construct, evaluate
from ..session import checkpointed, shared_folder
from ..sources import audit, graph_json, kernel_db, snapshots, star
from ..sources import labels as label_source

#: Objects of customers, orders and commands are numbered apart.
ORDERS, ODD_PART = 1_000_000_000, 7


def little(n: Column, size: int) -> Column:
    """The number's bytes, lowest first."""
    h = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(kernel_db.turned(h))


def key(pnode: Column, version: Column) -> Column:
    return F.concat(little(pnode, 8), little(version, 4))


def packed(code: str, payload: Column, ancestry: bool = False) -> Column:
    head = F.concat(little(F.lit(kernel_db.PACKED | kernel_db.ANCESTRY * ancestry), 1), little(F.lit(0), 1), little(F.lit(kernel_db.CODES.index(code)), 2))
    return F.concat(head, little(F.octet_length(payload), 4), payload)


def named(attr: str, payload: Column, ancestry: bool = False) -> Column:
    """A record that holds its attribute's name."""
    head = F.concat(little(F.lit(kernel_db.ANCESTRY * ancestry), 1), little(F.lit(0), 1), little(F.lit(len(attr)), 2))
    return F.concat(head, little(F.octet_length(payload), 4), F.encode(F.lit(attr), "UTF-8"), payload)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer k as version k % 2 of object k // 2, with its parent's object and version: k // 10."""
    k = F.col("c_custkey")
    half = lambda x: F.floor(x / 2).cast("long")
    up = F.floor(k / 10).cast("long")
    return star.table(spark, sf_dir, "customer").select(k.alias("k"), half(k).alias("pnode"), (k % 2).alias("version"), up.alias("up"), half(up).alias("up_pnode"), (up % 2).alias("up_version"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))


def parent_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child and parent keys: customers 10 and above have a parent, every order of a customer comes from it."""
    c = customers(spark, sf_dir)
    forks = c.where("k >= 10").select(key(F.col("pnode"), F.col("version")).alias("k"), key(F.col("up_pnode"), F.col("up_version")).alias("v"))
    o = star.table(spark, sf_dir, "orders").where(F.col("o_custkey") > 0)
    inputs = o.select(key(F.col("o_orderkey") + ORDERS, F.lit(0)).alias("k"), key(F.floor(F.col("o_custkey") / 2), F.col("o_custkey") % 2).alias("v"))
    return checkpointed(forks.union(inputs))


def prov_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute records: type and name (renamed once) at version 0 of an object, a name of its own for every ODD_PART-th customer, arguments, freeze times; FORKPARENT and INPUT with their mark."""
    c = customers(spark, sf_dir)
    text = lambda x: F.encode(F.concat(x, F.lit("\0")), "UTF-8")
    own = key(F.col("pnode"), F.col("version"))
    first = c.where("version = 0")
    rows = [
        first.select(own.alias("k"), packed("TYPE", text(F.lit("PROC"))).alias("v"), F.lit(1).alias("s")),
        first.select(own, packed("NAME", text(F.lit("old"))), F.lit(2)),
        first.select(own, packed("NAME", text(F.col("segment"))), F.lit(3)),
        c.where(f"k % {ODD_PART} = 0").select(own, packed("NAME", text(F.concat(F.lit("own"), F.col("k").cast("string")))), F.lit(4)),
        c.select(own, packed("ARGV", F.concat(little(F.col("nation"), 4), little(F.col("k") % 25, 4))), F.lit(5)),
        c.where("k % 3 = 0").select(own, named("PID", little(F.col("k"), 4)), F.lit(6)),
        c.where("k >= 10").select(own, named("FORKPARENT", key(F.col("up_pnode"), F.col("up_version")), True), F.lit(7)),
    ]
    o = star.table(spark, sf_dir, "orders").where(F.col("o_custkey") > 0).withColumn("own", key(F.col("o_orderkey") + ORDERS, F.lit(0)))
    rows += [
        o.select("own", packed("TYPE", text(F.lit("FILE"))), F.lit(1)),
        o.select("own", packed("FREEZETIME", F.concat(little(star.seconds("o_orderdate"), 4), little(F.col("o_orderkey") % 1000, 4))), F.lit(2)),
        o.select("own", packed("INPUT", key(F.floor(F.col("o_custkey") / 2), F.col("o_custkey") % 2), True), F.lit(3)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return checkpointed(out.select("k", "v", F.col("s").cast("long").alias("seq")))


def tokens_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = star.table(spark, sf_dir, "nation")
    return n.select(little(F.col("n_nationkey"), 4).alias("k"), F.encode(F.col("n_name"), "UTF-8").alias("v"))


def db_graph(spark: SparkSession, sf_dir: str) -> ProvGraph:
    return kernel_db.make_graph(parent_db(spark, sf_dir), prov_db(spark, sf_dir), tokens_db(spark, sf_dir), strict=True)


def db_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = db_graph(spark, sf_dir).nodes
    return nodes.select("id", "pnode", "version", "type", "name", F.col("freeze_sec").cast("long").alias("freeze_sec"), F.col("freeze_nsec").cast("long").alias("freeze_nsec"), F.try_element_at("attrs", F.lit("PID")).alias("pid"))


def db_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db_graph(spark, sf_dir).edges


def db_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kernel_db.decoded(kernel_db.records(prov_db(spark, sf_dir)), kernel_db.token_map(tokens_db(spark, sf_dir)))
    return found.where("attr = 'ARGV'").select("pnode", "version", F.array_join("items", " ").alias("argv"))


def db_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_db.token_map(tokens_db(spark, sf_dir))


def db_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_db.ancestry(parent_db(spark, sf_dir))


def db_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_db.dump(parent_db(spark, sf_dir), "s")


def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.attribute_report(db_graph(spark, sf_dir))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, seq, line: the events' records as tokens; every 50th lacks its trailer, every 40th its subject; purchases are renames, with doubled slashes."""
    e = star.audit_events(spark, sf_dir)
    number = F.col("event_id")
    own = star.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    e = e.join(own, "event_id")
    code = F.create_map(*(F.lit(x) for p in (("exit", 1), ("fork", 2), ("read", 72), ("write", 75), ("exec", 42)) for x in p))
    none = F.array().cast("array<string>")
    header = F.format_string("20,100,2,%d,0,%d,%09d", F.element_at(code, F.col("kind")), "time", F.pmod(number, F.lit(1000)))
    file = lambda n: F.concat(F.lit("35,/"), F.lit("/f"), n.cast("string"))
    paths = F.when(F.col("kind").isin("read", "write"), F.array(F.lit("35,/tmp//x"), file(F.col("k")))).when(F.col("kind") == "exec", F.array(F.lit("35,/tmp//x"), file(F.col("k")), file(F.col("k") + 1))).otherwise(none)
    subject = F.when(number % 40 != 0, F.array(F.concat(F.lit("36,1,2,3,4,5,"), F.col("pid").cast("string"), F.lit(",7,0,host")))).otherwise(none)
    back = F.array(F.concat(F.lit("39,0,"), F.col("k").cast("string")))
    trailer = F.when(number % 50 != 7, F.array(F.lit("19,100"))).otherwise(none)
    lines = F.concat(F.array(header), paths, subject, back, F.array(F.lit("99,ignored")), trailer)
    day = F.date_format("ts", "yyyyMMdd")
    ordered = e.select(day.alias("file"), "ts", "event_id", F.posexplode(lines).alias("i", "line"))
    return ordered.select("file", F.struct("ts", "event_id", "i").alias("seq"), "line")


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.records(audit_lines(spark, sf_dir))
    return found.select(F.col("seq.event_id").alias("number"), "event_id", "sec", "frac", "pid", "uid", "gid", "euid", "egid", "machine_id", "return_value", F.array_join("paths", " ").alias("paths"))


def audit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.events(audit.records(audit_lines(spark, sf_dir))).select(F.col("seq.seq.event_id").alias("number"), "kind", "pid", "child", "path", "path2", "time")


def rename_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of the audit text's graph: forks, uses and renames."""
    made = audit_graph.build(audit.events(audit.records(audit_lines(spark, sf_dir))))
    return made.edges.select("src", "dst", "type", "operation", F.col("time").alias("sec"))


def rename_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their normal path, base name and version."""
    made = audit_graph.build(audit.events(audit.records(audit_lines(spark, sf_dir))))
    return made.nodes.where("type = 'file'").select("id", "path", "name", "version")


def weekday_line(ts: str) -> Column:
    return F.date_format(ts, "EEE MMM d HH:mm:ss yyyy")


def exec_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as text audit of execs, one file; batches of 100, the last, unfilled one for good."""
    e = star.table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')")
    kind = F.when(F.col("event_type") == "purchase", "execve(2)").otherwise("open(2) - write")
    lines = F.array(
        F.concat(F.lit("header,90,2,"), kind, F.lit(",,"), weekday_line("ts"), F.lit(", + 5 msec")),
        F.lit("path,/first"),
        F.concat(F.lit("path,/bin/p"), F.get_json_object("props", "$.k")),
        F.concat(F.lit("subject,u,u,u,u,u,"), F.col("user_id").cast("string"), F.lit(","), (F.col("user_id") % 7).cast("string"), F.lit(",0 0 h")),
        F.lit("return,success,0"),
        F.lit("trailer,90"),
    )
    rows = e.select(F.lit("audit").alias("file"), "ts", "event_id", F.posexplode(lines).alias("i", "line")).select("file", F.struct("ts", "event_id", "i").alias("seq"), "line")
    return snapshots.from_audit(rows).select("batch", "end_ts", "pid", "ppid", "cmd")


def listed_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th event opens a process listing of its user and of the next."""
    e = star.table(spark, sf_dir, "events").where("event_id % 50 = 0")
    wide = lambda pid: F.lpad(pid.cast("string"), F.greatest(F.length(pid.cast("string")), F.lit(4)), " ")
    row = lambda pid: F.concat(F.repeat(F.lit(" "), F.lit(10)), wide(pid), F.repeat(F.lit(" "), F.lit(47)), F.concat(F.lit("/bin/p"), (pid % 9).cast("string"), F.lit(" -x")))
    lines = F.array(F.date_format("ts", "EEE MMM d HH:mm:ss 'EDT' yyyy"), F.rpad(F.lit("USER PID"), 64, " "), row(F.col("user_id")), row(F.col("user_id") + 1))
    rows = e.select(F.date_format("ts", "yyyyMMdd").alias("file"), "ts", "event_id", F.posexplode(lines).alias("i", "line")).select("file", F.struct("ts", "event_id", "i").alias("seq"), "line")
    return snapshots.from_listing(rows).select("file", "batch", "end_ts", "pid", "cmd")


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a label list, read back with the classes of their names."""
    e = star.table(spark, sf_dir, "events")
    names = F.array(*(F.lit(x) for x in ("-", "neptune", "ffb_clear2", "warezclient", "imap4", "unheard")))
    name = F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))
    lines = e.select(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit("  "), F.date_format("ts", "MM/dd/yyyy HH:mm:ss"), F.lit(" a b\tc d e f g "), name).alias("value")).union(spark.createDataFrame([("  ",)], "value string"))
    return label_source.parse(lines)


def label_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each type a choice of labels has; none rows are drawn."""
    return evaluate.select_labels(star.intrusion_labels(spark, sf_dir), 3).groupBy("type").agg(F.count("*").alias("n"))


def parent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untimed edges to parents that a name snapshot tells: each pid's is pid % 7."""
    graph = audit_graph.build(star.audit_events(spark, sf_dir))
    snapshot = graph.nodes.where("type = 'process'").select("pid", (F.col("pid").cast("long") % 7).cast("string").alias("ppid")).distinct()
    return audit_graph.parent_edges(graph, snapshot).select("src", "dst", "type")


def json_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel graph's edges, saved as JSON lines and loaded again, with the colours of both ends."""
    folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    graph_json.save(star.kernel_graph(spark, sf_dir), folder)
    back = graph_json.load(spark, folder)
    lines = graph_json.node_link_lines(back)
    nodes = lines.select(F.from_json("value", "kind string, id string, colour string").alias("r")).where("r.kind = 'node'").select("r.id", "r.colour")
    links = lines.select(F.from_json("value", "kind string, source string, target string, type string").alias("r")).where("r.kind = 'link'").select("r.source", "r.target", "r.type")
    return links.join(nodes.toDF("source", "source_colour"), "source").join(nodes.toDF("target", "target_colour"), "target").select("source", "target", "type", "source_colour", "target_colour")


def clean_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a listing's noise, blank ones gone."""
    e = star.table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 5 == 0, "ps -awwxu").when(F.col("event_id") % 5 == 1, F.concat(F.lit("ps -awwxu "), "event_type")).when(F.col("event_id") % 5 == 2, "  ").when(F.col("event_id") % 5 == 3, "-" * 40).otherwise(F.col("event_type"))
    return audit.cleaned(e.select("event_id", line.alias("line")), ("ps -awwxu", "-" * 40)).select("event_id", "line")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (db_nodes, db_edges, db_arguments, db_tokens, db_ancestry, db_dump, graph_report, audit_records, audit_kinds, rename_edges, rename_nodes, exec_snapshots, listed_processes, label_lines, label_choice, parent_links, json_edges, clean_listing)
    return {f.__name__: f for f in found}
