"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Every row is a leaf: the digest of its columns. The leaves of a group, in order
of a column, are the lowest level of a tree; each three consecutive nodes (the
last run may be shorter) have a parent, the digest of their digests, until one
node is left, the group's subroot. The subroots, in order of the groups, are
the leaves of one more tree, whose top is the root.

1. Numbering. Rows are range-partitioned and sorted by group and order; a
   row's place in its partition, less where its group begins there, plus the
   group's rows in earlier partitions, is its place in the group. A group of a
   third of all rows is spread over many partitions.
2. Levels. Blocks of 81 neighbours are gathered and make four levels at once.
3. Pointer jumping. Every node holds a pointer to its parent and a segment: the
   siblings on the way there. In each round a self-join appends to the segment
   of the node pointed from that of the node pointed to, and doubles the
   distance, until all pointers of leaves are at the top. Only nodes that a later
   round needs go on: in the round of distance d those at heights divisible
   by 2 d join those at the odd multiples of d.
4. The subroots' own paths to the root are appended.

A join's pointed-to side is broadcast if it has few rows (a checked bound);
beyond that there are many of them, and each has a bounded number of leaves.

Edge cases: a null group comes first, a null order value first in its group;
rows equal in both follow their leaf, and rows equal in all take consecutive
places; null and empty columns give different leaves; a single row is its
subroot; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwise.llm.common import stored
from wardwise.operators.joins import bounded_broadcast

FAN = 3
LEVELS = 4  # levels made at once
POWERS = [FAN**k for k in range(40)]
STEP = "array<struct<left: binary, right: binary>>"


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text."""
    return F.sha2(text, 256)


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of values: each its UTF-8 length, a colon and itself, or a dash if null."""
    values = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v), F.lit(":"), v)) for v in values]))


def _join(df: DataFrame, other: DataFrame, condition, how: str = "inner") -> DataFrame:
    return df.join(bounded_broadcast(other), condition, how)


def _numbered(df: DataFrame, group: str, order: str, leaf: str) -> tuple[DataFrame, DataFrame]:
    """Leaves (g, i, height, digest, row), and groups (g, height): groups and the leaves of each are numbered in order."""
    rows = df.select(F.col(f"`{group}`").alias("key"), F.col(f"`{order}`").alias("order"), F.col(f"`{leaf}`").alias("digest"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows too may be dealt apart
    by = [F.col("key").asc_nulls_first(), F.col("order").asc_nulls_first(), F.col("digest"), F.col("tie")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("tie", "order")
    placed = stored(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "merkle-rows")
    counts = stored(placed.groupBy("part", "key").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n")), "merkle-counts")
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a partition
    groups = counts.groupBy("key").agg(F.min("part").alias("first"), F.sum("n").alias("n"))
    begun = groups.groupBy("first").agg(F.count(F.lit(1)).alias("k"))  # one row a partition
    before = begun.select("first", F.coalesce(F.sum("k").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("first").orderBy(F.col("key").asc_nulls_first())) - 1  # groups that begin in one partition
    height = F.size(F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < F.col("n")))
    numbered = stored(groups.withColumn("nth", nth).join(before, "first").select("key", (F.col("before") + F.col("nth")).alias("g"), height.alias("height")), "merkle-groups")
    starts = counts.select("part", "key", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("begin")).alias("shift"))
    starts = starts.join(numbered, starts["key"].eqNullSafe(numbered["key"])).select("part", starts["key"].alias("k"), "shift", "g", "height")
    leaves = _join(placed.withColumnRenamed("part", "p"), starts, (F.col("p") == F.col("part")) & F.col("key").eqNullSafe(F.col("k")))
    return leaves.select("g", (F.col("at") + F.col("shift")).alias("i"), "height", "digest", "row"), numbered


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN))
    return F.transform(runs, lambda k: digest(F.array_join(F.slice(level, (k * FAN + 1).cast("int"), F.lit(FAN)), "")))


def _siblings(level: Column, k: Column) -> tuple[Column, Column]:
    """Digests of a node's siblings to the left and to the right, each as one binary."""
    first, at = (F.floor(k / FAN) * FAN).cast("int"), k % FAN
    left, right = F.slice(level, first + 1, at), F.slice(level, (k + 2).cast("int"), FAN - 1 - at)
    return F.unhex(F.array_join(left, "")), F.unhex(F.array_join(right, ""))


def _nodes(leaves: DataFrame, top: int) -> DataFrame:
    """(g, h, i, height, digest, left, right, row) of all nodes; the row is that of a leaf."""
    tiers, low, width = [], 0, FAN**LEVELS
    while True:
        gathered = leaves.groupBy("g", "height", F.floor(F.col("i") / width).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "digest", "row"))).alias("members"))
        made = gathered.withColumn("l0", F.col("members.digest"))
        for j in range(LEVELS):
            made = made.withColumn(f"l{j + 1}", F.when(F.col("height") > low + j, _parents(F.col(f"l{j}"))).otherwise(F.expr("CAST(array() AS array<string>)")))

        def level(j: int, low=low):
            def node(x: Column, k: Column) -> Column:
                left, right = _siblings(F.col(f"l{j}"), k)
                row = F.element_at("members", (k + 1).cast("int"))["row"]
                return F.struct(F.lit(low + j).alias("h"), (F.col("block") * FAN ** (LEVELS - j) + k).alias("i"), x.alias("digest"), left.alias("left"), right.alias("right"), (F.when(F.lit(j == 0), row)).alias("row"))

            return F.transform(f"l{j}", node)

        exploded = made.select("g", "height", F.inline(F.concat(*[level(j) for j in range(LEVELS + 1)])))
        tier = stored(exploded, "merkle-nodes")
        goes_on = (F.col("h") == low + LEVELS) & (F.col("height") > F.col("h"))
        tiers.append(tier.where(~goes_on))
        low += LEVELS
        if top <= low:
            break
        leaves = tier.where(goes_on).select("g", "i", "height", "digest", "row")
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.unionByName(tier)
    return out


def _paths(nodes: DataFrame, top: int) -> DataFrame:
    """(g, path, row): for each leaf, the siblings at every level up to the top of its tree."""
    own = F.when(F.col("h") < F.col("height"), F.array(F.struct("left", "right"))).otherwise(F.lit(None)).cast(STEP)
    to = F.least(F.col("h") + 1, F.col("height"))
    now = nodes.where("h = 0 OR h < height").select("g", "h", "i", "height", "row", F.coalesce(own, F.expr(f"CAST(array() AS {STEP})")).alias("path"), to.alias("to"), F.floor(F.col("i") / FAN).alias("to_i"))
    distance = 1
    while distance < top:
        pointed = now.where(F.col("h") % (2 * distance) == distance)
        pointed = pointed.select(F.col("g").alias("pg"), F.col("h").alias("ph"), F.col("i").alias("pi"), F.col("path").alias("on"), F.col("to").alias("on_to"), F.col("to_i").alias("on_i"))
        stay = now.where(F.col("h") % (2 * distance) == 0)
        going, there = stay.where("to < height"), stay.where("to = height")
        met = _join(going, pointed, (F.col("g") == F.col("pg")) & (F.col("to") == F.col("ph")) & (F.col("to_i") == F.col("pi")))
        met = met.select("g", "h", "i", "height", "row", F.concat("path", "on").alias("path"), F.col("on_to").alias("to"), F.col("on_i").alias("to_i"))
        now = stored(met.unionByName(there), "merkle-paths")
        distance *= 2
    return now.where("h = 0").select("g", "path", "row")


def _highest(df: DataFrame) -> int:
    return df.agg(F.max("height")).first()[0] or 0


def with_proofs(df: DataFrame, group_col: str, order_col: str, leaf_col: str) -> DataFrame:
    """``df`` plus ``subroot``, ``root`` and ``path`` (per level, the digests left and right of the node).

    ``leaf_col`` holds the leaves' digests. Columns of those names are replaced.
    """
    df = df.drop("subroot", "root", "path")
    leaves, groups = _numbered(df, group_col, order_col, leaf_col)
    top = _highest(groups)
    nodes = _nodes(leaves, top)
    subroots = nodes.where("h = height").select("g", "digest")
    n_groups = groups.count()
    crown_top = sum(p < n_groups for p in POWERS)
    crown = stored(subroots.select(F.lit(0).alias("g"), F.col("g").alias("i"), F.lit(crown_top).alias("height"), "digest", F.struct(F.col("g").alias("group"), F.col("digest").alias("subroot")).alias("row")), "merkle-subroots")
    crown_nodes = _nodes(crown, crown_top)
    root = crown_nodes.where(F.col("h") == F.col("height")).select(F.col("g").alias("zero"), F.col("digest").alias("root"))
    crown_paths = _join(_paths(crown_nodes, crown_top), root, F.col("g") == F.col("zero")).select(F.col("row.group").alias("group"), F.col("row.subroot").alias("subroot"), "root", F.col("path").alias("on"))
    paths = _join(_paths(nodes, top), stored(crown_paths, "merkle-crown"), F.col("g") == F.col("group"))
    return paths.select("row.*", "subroot", "root", F.concat("path", "on").alias("path"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(F.lower(F.hex(s["left"])), acc, F.lower(F.hex(s["right"])))))
