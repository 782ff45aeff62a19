"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is named by one of its nodes.

    Every round points each node at its smallest neighbour and contracts along the pointers, which at least halves the
    nodes. Each round is written to the shared folder, so that no lineage grows and a lost executor costs one round.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    names = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        lead = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                           .select("node", F.least("node", "low").alias("lead")), "leads")
        if names is None:
            names = lead.withColumnRenamed("lead", "component")
        else:
            names = names.join(lead, F.col("component") == lead["node"], "left").select(
                names["node"], F.coalesce("lead", "component").alias("component"))
        names = materialize(names, "names")
        first = edges.join(lead, F.col("a") == F.col("node")).select(F.col("lead").alias("a"), "b")
        second = first.join(lead, F.col("b") == F.col("node")).select("a", F.col("lead").alias("b"))
        edges = materialize(second.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return names if names is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
