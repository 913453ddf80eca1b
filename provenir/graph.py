"""A typed property graph held as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ProvGraph:
    """nodes: id, type, name and what else they have; edges: src, dst, type and what else they have. No parallel edges."""

    nodes: DataFrame
    edges: DataFrame

    def reverse(self) -> ProvGraph:
        """The same nodes with every edge turned round."""
        names = {"src": "dst", "dst": "src"}
        return ProvGraph(self.nodes, self.edges.select(*(F.col(names.get(c, c)).alias(c) for c in self.edges.columns)))

    def endpoints(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    def drop_isolated(self) -> ProvGraph:
        """Without the nodes that no edge touches."""
        return ProvGraph(self.nodes.join(self.endpoints(), "id", "left_semi"), self.edges)

    def unknown_names(self, default: str = "UNKNOWN") -> ProvGraph:
        """Processes without a name get the default one; other nodes keep none."""
        name = F.when(F.col("type") == "process", F.coalesce("name", F.lit(default))).otherwise(F.col("name"))
        return ProvGraph(self.nodes.withColumn("name", name), self.edges)

    def process_counts(self) -> DataFrame:
        """name, cnt over process nodes."""
        return self.nodes.where("type = 'process'").groupBy("name").agg(F.count("*").alias("cnt"))
