"""Consolidating pairwise matches into groups.

The giant component is peeled first: from the vertex of highest degree, a
frontier walks outwards by joins with the pairs, which stay as they are; a
step writes the vertices it is the first to reach, and the vertices of the two
last steps are all that it can meet again. Once a step adds less than ``tail``
of what has been reached, what still hangs on the giant (long, thin arms, where
a walk would take one step for each vertex) is left to the label loop, tied to
the start vertex by its boundary edges. Then one anti-join takes the giant's
pairs away, and the remaining components are labelled by minimum propagation
(``operators.components.propagate_minimum``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions import clean_name, present
from edgewise.model import named
from edgewise.operators.components import LOCAL_PAIRS, Labels, NodeIds, propagate_minimum
from edgewise.store import drop, write_table

#: Ids that a frontier, or all that was reached, may have to be broadcast: 8 MB of ids, about 30 MB as a hash table. More are joined by a shuffle.
BROADCAST_IDS = 500_000


def _sent(ids: DataFrame, size: int, broadcast_ids: int) -> DataFrame:
    return F.broadcast(ids) if size <= broadcast_ids else ids


def _marked(pairs: DataFrame, ids: DataFrame, size: int, broadcast_ids: int) -> DataFrame:
    """``pairs`` with ``in_a`` and ``in_b``, true where the end is among ``ids``."""
    at = lambda end: _sent(ids.select(F.col("node").alias(end), F.lit(True).alias(f"in_{end}")), size, broadcast_ids)
    return pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")


def peel(pairs: DataFrame, start: int, tail: float = 0.01, broadcast_ids: int = BROADCAST_IDS, max_steps: int = 1000) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Walks from ``start`` over ``pairs`` (``a``, ``b``). Gives the vertices
    that were reached (``node``), to be broadcast if they are few, the written
    tables they are in, and the written pairs that are left: those without a vertex that was reached and, where
    the walk ended early, pairs that tie ``start`` to what hangs on it."""
    spark = pairs.sparkSession
    frontier, size, reached = write_table(spark.createDataFrame([(start,)], "node bigint"), "reached"), 1, 1
    steps, ended = [frontier], False
    for _ in range(max_steps):
        at = _marked(pairs, frontier, size, broadcast_ids).filter("in_a is null and in_b or in_a and in_b is null")
        ahead = at.select(F.when(F.col("in_a"), F.col("b")).otherwise(F.col("a")).alias("node")).distinct()
        # A neighbour of a step's vertex is in that step, the one before or the next.
        for known in steps[-2:]:
            ahead = ahead.join(known, "node", "left_anti")
        following = write_table(ahead, "reached")
        size = following.count()
        if size == 0:
            drop(following)
            ended = True
            break
        steps.append(following)
        frontier, reached = following, reached + size
        if size < tail * reached:
            break
    everything = _sent(reduce(DataFrame.unionAll, steps), reached, broadcast_ids)
    if ended:  # both ends of a pair were reached, or none
        rest = pairs.join(everything.withColumnRenamed("node", "a"), "a", "left_anti")
    else:
        left = _marked(pairs, everything, reached, broadcast_ids).filter("in_a is null or in_b is null")
        outer = F.when(F.col("in_a"), F.col("b")).otherwise(F.col("a"))
        tied = F.col("in_a").isNotNull() | F.col("in_b").isNotNull()
        rest = left.select(F.when(tied, F.least(outer, F.lit(start))).otherwise(F.col("a")).alias("a"), F.when(tied, F.greatest(outer, F.lit(start))).otherwise(F.col("b")).alias("b"))
    return everything, steps, write_table(rest.select("a", "b"), "rest")


def match_groups(
    edges: DataFrame, from_col: str | Column = "from", to_col: str | Column = "to", tail: float = 0.01, broadcast_ids: int = BROADCAST_IDS, local_pairs: int = LOCAL_PAIRS, bits: int = 63
) -> DataFrame:
    """``(node, group_key)``: one row for each node, with the smallest node (by
    bytes) of all nodes linked to it directly or through others.

    Nodes are clean values (white space at the ends stripped, upper case). A
    row with a missing end (null, empty, ``N/A``) links nothing and names no
    node. A row that names one node twice makes it a node. Repeated rows and
    the same pair in both directions count once. An empty table gives an empty
    result; other columns, whatever their names, are not read. No component,
    link or label goes to the driver: only the start vertex and counts do.

    ``tail``: the walk over the giant component ends once a step adds less
    than this share of what it reached. ``broadcast_ids``: the largest number
    of ids (counted) that is broadcast. ``local_pairs``: pairs that one task
    labels at the end of the label loop. ``bits``: of the hashed ids. Whether
    two names share an id is seen when names and labels meet by id; the names
    that do then get ids of their own, and the pairs are labelled again."""
    ends = edges.select(clean_name(named(from_col)).alias("f"), clean_name(named(to_col)).alias("t")).filter(present("f") & present("t"))
    nodes = write_table(ends.select(F.explode(F.array("f", "t")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")), "nodes")
    ids = NodeIds(bits=bits)
    while True:
        # The start is the vertex of highest degree.
        top = ids.add(nodes.select(F.max(F.struct("degree", "node")).alias("top")).select("top.node"), id="node").first()["id"]
        if top is None:
            return nodes.select("node", F.col("node").alias("group_key"))
        grouped, root = _grouped(ids.add(ends.filter("f <> t"), a="f", b="t"), nodes.select("node"), ids, top, tail, broadcast_ids, local_pairs)
        clashing = grouped.filter("names > 1").select(F.col("node").alias("name"))
        if clashing.isEmpty():
            break
        ids = NodeIds.renaming(clashing, bits)
        drop(grouped)
    drop(nodes)
    giant, others = grouped.filter(F.col("root") == root), grouped.filter(F.col("root") != root)
    keys = others.groupBy("root").agg(F.min("node").alias("group_key"))
    # The giant's key is one row.
    key = giant.agg(F.min("node").alias("group_key"))
    return others.join(keys, "root").select("node", "group_key").unionAll(giant.crossJoin(F.broadcast(key)).select("node", "group_key"))


def _grouped(ends: DataFrame, nodes: DataFrame, ids: NodeIds, start: int, tail: float, broadcast_ids: int, local_pairs: int) -> tuple[DataFrame, int]:
    """``(node, root, names)`` as a written table, where ``names`` is the
    number of nodes with the same id, and the giant's root."""
    pairs = write_table(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs")
    reached, steps, rest = peel(pairs, start, tail, broadcast_ids)
    drop(pairs)
    small = propagate_minimum(rest, local_pairs=local_pairs)
    # The label loop may have given the start vertex, and what hangs on it, another's id as root.
    root = small.root_of(start)
    vertex = ids.expression("node")
    if vertex is None:
        nodes, vertex = ids.add(nodes, id="node"), F.col("id")
    labelled = Labels([*small.frames, reached.withColumn("root", F.lit(root))], []).add(nodes, root=vertex)
    sharing = F.count("*").over(Window.partitionBy(vertex))
    grouped = write_table(labelled.select("node", "root", sharing.alias("names")), "grouped")
    drop(rest, *steps)
    small.drop()
    return grouped, root
