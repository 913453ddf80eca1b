"""Kernel provenance: from ancestry pairs and attribute records to a typed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display_name, node_id
from ..graph import ProvGraph

KEY = ["pnode", "version"]
#: Attributes that describe ancestry and aren't inherited.
ANCESTRY_ATTRS = ("ANCESTRY", "INPUT", "FORKPARENT")


def known_nodes(ancestry: DataFrame) -> DataFrame:
    """pnode, version: both ends of each ancestry pair, and version 0 of each object."""
    ends = F.array(*(F.struct(F.col(f"{e}_pnode").alias("pnode"), F.col(f"{e}_version").alias("version")) for e in ("parent", "child")), *(F.struct(F.col(f"{e}_pnode").alias("pnode"), F.lit(0).cast("long").alias("version")) for e in ("parent", "child")))
    return ancestry.select(F.explode(ends).alias("n")).select("n.pnode", "n.version").distinct()


def latest_attributes(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """pnode, version, attrs: the last value (by seq) of each attribute of each known node; INPUT rows are left out."""
    last = records.where("attr <> 'INPUT'").join(nodes, KEY, "left_semi").groupBy(*KEY, "attr").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("attrs"))


def inherit(nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    """nodes with `attrs`: those of the object's version 0 but for ancestry, overridden by the version's own."""
    without = F.map_filter("attrs", lambda k, _: ~k.isin(*ANCESTRY_ATTRS))
    first = attrs.where("version = 0").select("pnode", without.alias("base"))
    own = attrs.select(*KEY, without.alias("own"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    base, mine = F.coalesce("base", empty), F.coalesce("own", empty)
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(mine, k)), mine)
    return nodes.join(first, "pnode", "left").join(own, KEY, "left").select(*KEY, merged.alias("attrs"))


def version_edges(nodes: DataFrame) -> DataFrame:
    """src_pnode, src_version, dst_pnode, dst_version from each version to the next, whether or not the earlier one was seen."""
    return nodes.where("version >= 1").select(F.col("pnode").alias("src_pnode"), (F.col("version") - 1).alias("src_version"), F.col("pnode").alias("dst_pnode"), F.col("version").alias("dst_version"))


def resolve_types(ancestry: DataFrame, inputs: DataFrame, forks: DataFrame, versions: DataFrame, strict: bool = False) -> DataFrame:
    """src, dst, type: one edge for each pair. INPUT and FORKPARENT go before VERSION; a node with inputs has no fork edge; ancestry alone leaves the type NULL.

    Each is a table of src and dst. strict: raise if an input or fork edge isn't in ancestry, as is asserted of such databases.
    """
    forks = forks.join(inputs.select("dst").distinct(), "dst", "left_anti").select("src", "dst")
    if strict:
        loose = inputs.select("src", "dst").union(forks).join(ancestry, ["src", "dst"], "left_anti")
        if row := loose.first():
            raise ValueError(f"edge {row.src} -> {row.dst} has no ancestry")
    ranked = ancestry.select("src", "dst", F.lit(9).alias("k")).union(versions.select("src", "dst", F.lit(3))).union(forks.select("src", "dst", F.lit(2))).union(inputs.select("src", "dst", F.lit(1)))
    names = F.when(F.col("k") == 1, "INPUT").when(F.col("k") == 2, "FORKPARENT").when(F.col("k") == 3, "VERSION")
    return ranked.groupBy("src", "dst").agg(F.min("k").alias("k")).select("src", "dst", names.alias("type"))


def make_graph(ancestry: DataFrame, records: DataFrame, strict: bool = False) -> ProvGraph:
    """The graph of ancestry (parent_pnode, parent_version, child_pnode, child_version) and decoded records (pnode, version, attr, value, ref_pnode, ref_version, ancestry, seq).

    Only records of known nodes count; INPUT and FORKPARENT need an ANCESTRY mark on the node. strict: raise if
    an input or fork edge has no ancestry (see resolve_types).
    """
    nodes = known_nodes(ancestry)
    own = records.join(nodes, KEY, "left_semi")
    marked = own.where("ancestry").select(*KEY).distinct()
    refs = own.join(marked, KEY, "left_semi")
    pair = (node_id(F.col("ref_pnode"), F.col("ref_version")).alias("src"), node_id(F.col("pnode"), F.col("version")).alias("dst"))
    inputs = refs.where("attr = 'INPUT'").select(*pair).distinct()
    forks = refs.where("attr = 'FORKPARENT'").groupBy(*KEY).agg(F.max_by(F.struct("ref_pnode", "ref_version"), "seq").alias("r")).select(*KEY, "r.*").select(*pair)
    steps = version_edges(nodes)
    versions = steps.select(node_id(F.col("src_pnode"), F.col("src_version")).alias("src"), node_id(F.col("dst_pnode"), F.col("dst_version")).alias("dst"))
    parents = ancestry.select(node_id(F.col("parent_pnode"), F.col("parent_version")).alias("src"), node_id(F.col("child_pnode"), F.col("child_version")).alias("dst")).distinct()
    full = inherit(nodes, latest_attributes(records, nodes))
    bare = steps.select(F.col("src_pnode").alias("pnode"), F.col("src_version").alias("version")).distinct().join(nodes, KEY, "left_anti").withColumn("attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = full.unionByName(bare)
    freeze = F.split(F.try_element_at("attrs", F.lit("FREEZETIME")), r"\.")
    table = rows.select(node_id(F.col("pnode"), F.col("version")).alias("id"), *KEY, F.try_element_at("attrs", F.lit("TYPE")).alias("type"), display_name(F.try_element_at("attrs", F.lit("NAME")), F.col("pnode"), F.col("version")).alias("name"), F.get(freeze, 0).cast("int").alias("freeze_sec"), F.get(freeze, 1).cast("int").alias("freeze_nsec"), "attrs")
    return ProvGraph(table, resolve_types(parents, inputs, forks, versions, strict))


def attribute_report(graph: ProvGraph) -> DataFrame:
    """pnode, version, key, value: the graph's nodes with their attributes, in order; a node without any has one row with a NULL key."""
    rows = graph.nodes.select(*KEY, F.explode_outer("attrs").alias("key", "value"))
    return rows.orderBy("pnode", "version", "key")


def report_lines(graph: ProvGraph) -> DataFrame:
    """line: the same as text, an object's number before its versions, a version before its attributes."""
    rows = attribute_report(graph)
    heads = graph.nodes.select("pnode", F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("key"), F.col("pnode").cast("string").alias("line")).distinct()
    steps = graph.nodes.select(*KEY, F.lit(None).cast("string").alias("key"), F.concat(F.lit("-> "), F.col("version").cast("string")).alias("line"))
    attrs = rows.where("key is not null").select(*KEY, "key", F.concat(F.lit("---> "), "key", F.lit(" -> "), F.coalesce("value", F.lit(""))).alias("line"))
    return heads.union(steps).union(attrs).orderBy("pnode", F.asc_nulls_first("version"), F.asc_nulls_first("key")).select("line")
