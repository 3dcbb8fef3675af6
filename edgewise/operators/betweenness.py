"""Exact betweenness centrality of unweighted graphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.model import Scopes, edge_rows, multiplicities, node_list
from edgewise.operators.components import NodeIds
from edgewise.operators.small_graphs import LOCAL_EDGES, dependencies, from_every_node
from edgewise.store import append_table, drop, new_path, write_table

#: Rows of state (pairs of a source and a node it reaches) that a batch of sources may have.
STATE_ROWS = 500_000_000


def _source_batch(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``(node, part)``: the dependencies of the paths from ``sources`` on each
    node, as a written table.

    Forward, level by level: the number of shortest paths ``sigma`` from each
    source to the nodes first seen at this level, added to one table of all
    that was seen, which is read as one to leave out what leads back. Backward
    from the deepest level: a node's dependency is the sum, over the links to
    the next level, of its share of that node's paths times one plus that
    node's dependency."""
    spark = links.sparkSession
    path, parts_path, depth = new_path(spark, "bc-seen"), new_path(spark, "bc-delta"), 0
    seen = append_table(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("sigma"), F.lit(0).alias("level")), path)
    while True:
        last = seen.filter(F.col("level") == depth).select("s", F.col("node").alias("src"), "sigma")
        ahead = last.join(links, "src").groupBy("s", F.col("dst").alias("node")).agg(F.sum(F.col("sigma") * F.col("mult")).alias("sigma"))
        # Directed links can lead back to any level before.
        fresh = ahead.join(seen.select("s", "node"), ["s", "node"], "left_anti")
        seen = append_table(fresh.select("s", "node", "sigma", F.lit(depth + 1).alias("level")), path)
        if seen.filter(F.col("level") == depth + 1).isEmpty():
            break
        depth += 1
    if not depth:
        drop(seen)
        return write_table(spark.createDataFrame([], "node bigint, part double"), "bc-parts")
    deepest = seen.filter(F.col("level") == depth).select("s", "node", "sigma", F.lit(0.0).alias("delta"), "level")
    parts = append_table(deepest, parts_path)
    for level in range(depth - 1, 0, -1):
        here = seen.filter(F.col("level") == level).select("s", F.col("node").alias("src"), F.col("sigma").alias("sv"))
        below = parts.filter(F.col("level") == level + 1).select("s", F.col("node").alias("dst"), F.col("sigma").alias("sw"), "delta")
        flows = here.join(links, "src").join(below, ["s", "dst"]).groupBy("s", "src").agg(F.sum(F.col("mult") * F.col("sv") / F.col("sw") * (1 + F.col("delta"))).alias("delta"))
        found = here.join(flows, ["s", "src"], "left").select("s", F.col("src").alias("node"), F.col("sv").alias("sigma"), F.coalesce("delta", F.lit(0.0)).alias("delta"), F.lit(level).alias("level"))
        parts = append_table(found, parts_path)
    whole = write_table(parts.groupBy("node").agg(F.sum("delta").alias("part")), "bc-parts")
    drop(seen, parts)
    return whole


def betweenness_centrality(
    df: DataFrame,
    from_col: str | Column,
    to_col: str | Column,
    normalized: bool = True,
    directed: bool = False,
    batches: int | None = None,
    local_edges: int = LOCAL_EDGES,
    partition_by: Sequence[str | Column] = (),
) -> DataFrame:
    """``(node, centrality)``: one row for every node.

    Columns may be names or expressions. Paths are shortest by number of
    edges; parallel edges are different paths (so is an undirected pair given
    in both directions), loops are on none, ends of a path don't count.
    Undirected values are halved. Normalised values are divided by the number
    of pairs of other nodes, which makes them NaN in a graph of one or two
    nodes. Rows with a null end take no part; an empty table gives no row;
    other columns are not read. With ``partition_by``, each combination of its
    values is a graph of its own, and the values come first in the result.

    The sources of a batch advance together, one level a round. ``batches``
    cuts the sources by a hash of their name; by default there are as many as
    keep the state, at most a row for each pair of nodes, within half a billion
    rows. With at most ``local_edges`` merged edges (counted), each task works
    through its share of the sources in arrays instead."""
    scopes = Scopes(df, partition_by)
    edges = write_table(edge_rows(df, from_col, to_col, scopes=scopes), "bc-edges")
    links = write_table(multiplicities(edges.filter("src <> dst"), directed), "bc-links")
    nodes = write_table(node_list(edges), "bc-nodes")
    drop(edges)
    merged = links.count()
    if 0 < merged <= local_edges:
        total = from_every_node(links, merged, node_list(links).count(), dependencies, ["src", "dst", "mult"], "node string, part double").groupBy("node").agg(F.sum("part").alias("part"))
    else:  # by ids; names come back at the end
        ids = NodeIds.of(nodes)
        placed = ids.add(nodes, id="node")
        coded = write_table(ids.add(links, s="src", t="dst").select(F.col("s").alias("src"), F.col("t").alias("dst"), "mult"), "bc-coded")
        cut = batches or max(1, -(-(nodes.count() ** 2) // STATE_ROWS))
        parts = [_source_batch(coded, placed.filter(F.pmod(F.xxhash64("id"), F.lit(cut)) == k).select(F.col("id").alias("node"))) for k in range(cut)]
        drop(links, coded)
        sums = reduce(DataFrame.unionAll, parts).groupBy("node").agg(F.sum("part").alias("part")).withColumnRenamed("node", "id")
        total = placed.join(sums, "id").select("node", "part")
    found = nodes.join(total, "node", "left").withColumn("graph", scopes.of(F.col("node")))
    value = F.coalesce("part", F.lit(0.0)) * F.lit(1.0 if directed else 0.5)
    if normalized:
        sizes = nodes.groupBy(scopes.of(F.col("node")).alias("of")).agg(F.count("*").cast("double").alias("n"))
        found = found.join(sizes, F.col("graph") == F.col("of"))
        pairs = (F.col("n") - 1) * (F.col("n") - 2)
        value = F.when(F.col("n") <= 2, F.lit(float("nan"))).otherwise(value * F.lit(1.0 if directed else 2.0) / pairs)
    return scopes.named_rows(found, F.col("graph"), scopes.bare(F.col("node")).alias("node"), value.alias("centrality"))
