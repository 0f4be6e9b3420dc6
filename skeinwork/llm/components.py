"""Connected components of an edge table, by shared minima and shortcuts.

Every round each node takes the least label among its own and its neighbours', then
the label of its label. Tables between the steps are written, so lineage stays short.
A node with very many neighbours, and a label that very many nodes have, is a hot key
of these look-ups: such keys are few by their share of the rows; only their lines are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from ._common import heavy_keys, looked_up


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """From ``a``, ``b`` (longs): ``node`` and ``component``, the least node of its
    component, for every node of an edge. Repeated edges and loops change nothing; no
    edges give no rows. The result is a table of ``scratch``."""
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = scratch.keep(edges.select(F.explode(ends).alias("e")).select("e.u", "e.v"))
    # Edges go both ways, so a node's neighbours are its rows in either column.
    labels = scratch.keep(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("component"), F.count("*").alias("n")))
    n_edges, n_nodes = both.count(), labels.count()
    hubs = heavy_keys(labels, "node", n_edges)
    while True:
        told = looked_up(both, "v", labels.select(F.col("node").alias("v"), "component"), hubs)
        heard = told.groupBy(F.col("u").alias("node")).agg(F.min("component").alias("heard"))
        lower = scratch.keep(labels.join(heard, "node").select("node", F.least("component", "heard").alias("to"), "component"))
        if lower.filter("to <> component").isEmpty():
            # Neighbours agree everywhere, so each component has one label, its least node.
            scratch.drop(both, lower)
            return labels.select("node", "component")
        common = heavy_keys(lower.groupBy("to").agg(F.count("*").alias("n")), "to", n_nodes)
        further = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = scratch.keep(looked_up(lower, "to", further, common).select("node", F.col("further").alias("component")))
        scratch.drop(labels, lower)
        labels = new
