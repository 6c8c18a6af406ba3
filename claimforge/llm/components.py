"""Connected components of an edge table by least labels with pointer jumping.

A round gives every node the least label of its neighbours and itself, then the label of its
label, which halves the way to the component's least node.  A round is two joins and a
grouped minimum over the distributed tables, and its labels are written below the shared
checkpoint folder.  The joined tables are read from there, so both sides of each join are
plain exchanges and a hot node can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimforge.llm.common import cut

MOST_ROUNDS = 100


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge, component being its smallest reachable node."""
    ends = F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))
    edges = cut(edges.filter(F.col(a) != F.col(b)).select(ends.alias("e")).select("e.u", "e.v").distinct(), "edges")
    first = edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
    labels = cut(first, "labels")
    for _ in range(MOST_ROUNDS):
        near = edges.join(labels, F.col("u") == F.col("node")).groupBy(F.col("v").alias("near")).agg(F.min("label").alias("least"))
        own = labels.join(near, F.col("node") == F.col("near")).select("node", F.col("label").alias("old"), F.least("label", "least").alias("to"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        after = own.join(up, F.col("to") == F.col("up")).select("node", "old", F.least("to", "upper").alias("label"))
        labels = cut(after, "labels")
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
