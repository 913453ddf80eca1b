"""Graphs as JSON: one document of node and edge lists, or two folders of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import ProvGraph

#: Colours of node types, others are black: fixed values of the drawing.
COLOURS = {"PROC": "r", "FILE": "g", "NP_FILE": "b", "PIPE": "y", "DIR": "o"}


def save(graph: ProvGraph, folder: str) -> None:
    """nodes and edges, a folder of JSON lines each, written in parallel."""
    graph.nodes.write.mode("overwrite").json(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").json(f"{folder}/edges")


def load(spark: SparkSession, folder: str) -> ProvGraph:
    return ProvGraph(spark.read.json(f"{folder}/nodes"), spark.read.json(f"{folder}/edges"))


def load_document(spark: SparkSession, path: str) -> ProvGraph:
    """{"nodes": [[id, {attribute: value}]], "edges": [[src, dst, {attribute: value}]]}; values become strings, a missing type or name NULL."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "nodes array<array<string>>, edges array<array<string>>").alias("g"))
    attrs = lambda c: F.from_json(c, "map<string,string>")
    nodes = raw.select(F.explode("g.nodes").alias("n")).select(F.get("n", 0).alias("id"), attrs(F.get("n", 1)).alias("attrs"))
    edges = raw.select(F.explode("g.edges").alias("e")).select(F.get("e", 0).alias("src"), F.get("e", 1).alias("dst"), attrs(F.get("e", 2)).alias("attrs"))
    pick = lambda k: F.try_element_at("attrs", F.lit(k)).alias(k)
    named = nodes.select("id", pick("type"), F.coalesce(F.try_element_at("attrs", F.lit("cmd")), F.try_element_at("attrs", F.lit("filename"))).alias("name"), "attrs")
    return ProvGraph(named, edges.select("src", "dst", pick("type"), pick("operation"), F.try_element_at("attrs", F.lit("time")).try_cast("decimal(38,0)").alias("time"), "attrs"))


def node_link_lines(graph: ProvGraph) -> DataFrame:
    """value: a JSON line for each node and link, nodes with their colour."""
    colours = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    nodes = graph.nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "type", "name", F.coalesce(F.try_element_at(colours, F.col("type")), F.lit("k")).alias("colour"))).alias("value"))
    return nodes.union(graph.edges.select(F.to_json(F.struct(F.lit("link").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"), "type")).alias("value")))
