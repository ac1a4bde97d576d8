"""Connected components of a graph given as an edge table, by hooking and contraction.

Each round hooks every node onto its smallest smaller neighbour, follows the
parents to their roots by pointer jumping, and contracts the edges to edges
between roots. It ends when no edge is left, so the label of a node is always
the smallest node that it can reach. Every step is a join or an aggregate on
tables in the shared folder; nothing is collected but row counts. Joins on a
popular root are left to adaptive execution, which splits them: both sides are
plain scans of stored tables.

Edge cases: loops and repeated edges are ignored; null ends are dropped; an
empty edge table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardwise.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b)."""
    ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    left = stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*ends).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        hooked = _jump(stored(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooked"))  # roots have no row
        contracted = _relabel(_relabel(left, hooked, "a"), hooked, "b")
        left = stored(contracted.where("a <> b").select(*ends).distinct(), "edges")
        if labels is None:
            labels = hooked
        else:
            labels = stored(_relabel(labels, hooked, "root").unionByName(hooked), "labels")
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def _jump(parents: DataFrame) -> DataFrame:
    """Follow parents (node, root) until every root is a node without a parent."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        jumped = stored(parents.join(up, "root", "left").select("node", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("moved")), "jumped")
        if jumped.where("moved").isEmpty():
            return jumped.select("node", "root")
        parents = jumped.select("node", "root")


def _relabel(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``df`` with the nodes in ``column`` replaced by their roots."""
    to = labels.select(F.col("node").alias(column), F.col("root").alias("__to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to").select(df.columns)
