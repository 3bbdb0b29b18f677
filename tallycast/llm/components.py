"""Connected components of an edge table by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import written

#: Doublings of the parent pointers in each round.
JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (columns a, b: long); nodes that edges join share a label.

    Each round, every node takes its least neighbour, or itself, as parent, pointers are doubled, nodes and edges
    are renamed to the parents reached, and edges within one name go. Renaming keeps what is connected connected,
    and it ends when no edge is left. Every table is written, so joins read two plain scans and adaptive execution
    can split a name that very many nodes share; minima are summed up before the shuffle."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        parent = written(both.groupBy(F.col("e.u").alias("u")).agg(F.min("e.v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        for _ in range(JUMPS):
            above = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            parent = written(parent.join(above, "p").select("u", F.col("q").alias("p")), "parents")
        up = lambda x: parent.select(F.col("u").alias(x), F.col("p").alias(f"{x}_p"))
        renamed = labels.join(up("label"), "label", "left").select("node", F.coalesce("label_p", "label").alias("label"))
        labels = written(renamed, "labels")
        moved = edges.join(up("a"), "a").join(up("b"), "b").where("a_p <> b_p")
        edges = written(moved.select(F.least("a_p", "b_p").alias("a"), F.greatest("a_p", "b_p").alias("b")).distinct(), "edges")
    return labels
