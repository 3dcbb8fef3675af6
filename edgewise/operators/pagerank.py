"""PageRank by power iteration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.functions.naming import free_names
from edgewise.model import Scopes, edge_rows, multiplicities, named, node_list
from edgewise.operators.components import NodeIds
from edgewise.operators.small_graphs import RANKED_EDGES, page_rank_arrays
from edgewise.store import append_table, drop, new_path, write_table


def _scores(
    scopes: Scopes, df: DataFrame, from_col: str | Column, to_col: str | Column, damping_factor: float, max_iterations: int, convergence_threshold: float, redistribute_dangling: bool, local_edges: int
) -> DataFrame:
    """``(node, score, iterations)``, with the names of ``scopes``."""
    merged = write_table(multiplicities(edge_rows(df, from_col, to_col, scopes=scopes), directed=True), "pr-merged")
    d = float(damping_factor)
    if merged.count() <= local_edges:
        run = page_rank_arrays(d, max_iterations, convergence_threshold, redistribute_dangling, bool(scopes.keys))
        return merged.repartition(1).mapInArrow(run, "node string, score double, iterations int")
    # The rounds run on ids; names come back at the end.
    nodes = write_table(node_list(merged), "pr-nodes")
    ids = NodeIds.of(nodes)
    degrees = merged.groupBy("src").agg(F.sum("mult").alias("degree"))
    links = write_table(ids.add(merged.join(degrees, "src"), s="src", t="dst").select("s", "t", (F.col("mult") / F.col("degree")).alias("share")), "pr-links")
    placed = ids.add(nodes, id="node")
    graph = scopes.of(F.col("node")) if scopes.keys else F.lit("")
    sized = placed.select("id", graph.alias("graph"))
    sizes = sized.groupBy("graph").agg(F.count("*").alias("n"))
    scores = write_table(sized.join(sizes, "graph").select("id", "graph", "n", (F.lit(1.0) / F.col("n")).alias("score")), "pr-scores")
    drop(merged)
    # Graphs that have converged, with the rounds they took.
    path, ended, done = new_path(df.sparkSession, "pr-ended"), None, 0
    for done in range(1, max_iterations + 1):
        flows = links.join(scores.select(F.col("id").alias("s"), "score"), "s").select(F.col("t").alias("id"), (F.col("score") * F.col("share")).alias("flow"))
        # Scores and flows meet in one group, so a round has one shuffle of flows and none for a second join.
        own = [F.lit(0.0).alias("flow"), F.col("score").alias("before"), "n", "graph"]
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("before", "double"), ("n", "bigint"), ("graph", "string"))]
        met = flows.select("id", "flow", *none[: 2 + bool(scopes.keys)]).unionAll(scores.select("id", *own[: 3 + bool(scopes.keys)]))
        facts = [F.sum("flow").alias("flow"), F.max("before").alias("before"), F.max("n").alias("n"), F.max("graph").alias("graph")]
        summed = met.groupBy("id").agg(*facts[: 3 + bool(scopes.keys)])
        summed = summed if scopes.keys else summed.withColumn("graph", F.lit(""))
        lost = F.lit(0.0)
        if redistribute_dangling:
            # What a graph's nodes had and didn't pass on.
            kept = summed.groupBy("graph").agg((F.sum("before") - F.sum("flow")).alias("lost"))
            summed, lost = summed.join(kept, "graph"), F.lit(d) * F.col("lost") / F.col("n")
        score = F.lit(1.0 - d) / F.col("n") + lost + F.lit(d) * F.col("flow")
        following = write_table(summed.select("id", "graph", "n", score.alias("score"), "before"), "pr-scores")
        changes = following.groupBy("graph").agg(F.sum(F.abs(F.col("score") - F.col("before"))).alias("change"))
        drop(scores)
        scores = following.drop("before")
        if not scopes.keys:
            if changes.filter(F.col("change") >= F.lit(convergence_threshold)).isEmpty():
                break
            scores = following
            continue
        settled = write_table(changes.select("graph", (F.col("change") < F.lit(convergence_threshold)).alias("settled")), "pr-changes")
        left = settled.filter("not settled")
        if not settled.filter("settled").isEmpty():
            ended = append_table(scores.join(settled.filter("settled").select("graph"), "graph").select("id", "score", F.lit(done).alias("iterations")), path)
            active = write_table(scores.join(left.select("graph"), "graph"), "pr-scores")
            drop(following)
            following = active
        scores, over = following, left.isEmpty()
        drop(settled)
        if over:
            break
    drop(links)
    rest = scores.select("id", "score", F.lit(done).cast("int").alias("iterations"))
    return placed.join(rest if ended is None else rest.unionAll(ended), "id").select("node", "score", "iterations")


def page_rank_nodes(
    df: DataFrame,
    from_col: str | Column,
    to_col: str | Column,
    damping_factor: float = 0.85,
    max_iterations: int = 100,
    convergence_threshold: float = 1e-6,
    redistribute_dangling: bool = False,
    local_edges: int = RANKED_EDGES,
    partition_by: Sequence[str | Column] = (),
) -> DataFrame:
    """``(node, score, iterations)``: one row for every node, sinks included.

    Columns may be names or expressions. Every node starts at 1/n. An
    iteration gives a node (1-d)/n plus d times the sum, over the edges into
    it, of the source's score over the source's number of edges; parallel
    edges count each. It ends after the iteration in which the scores changed
    by less than ``convergence_threshold`` in all, or after
    ``max_iterations``. The score of nodes without edges out of them is lost
    unless ``redistribute_dangling`` spreads it evenly. Rows with a null end
    take no part; an empty table gives no row. With ``partition_by``, each
    combination of its values is a graph of its own, with its own n and end,
    and the values come first in the result.

    Parallel edges are merged and divided by the out-degree once, before the
    loop. A round is one join by source and one sum by target, which is
    combined before its shuffle; the round's scores are written together with
    the change, so that the test for convergence reads no more than that, and
    graphs that have converged leave the loop. With at most ``local_edges``
    merged edges (counted), the iterations run in arrays of one task instead."""
    scopes = Scopes(df, partition_by)
    scores = _scores(scopes, df, from_col, to_col, damping_factor, max_iterations, convergence_threshold, redistribute_dangling, local_edges)
    return scopes.named_rows(scores, scopes.of(F.col("node")), scopes.bare(F.col("node")).alias("node"), F.col("score"), F.col("iterations"))


def page_rank(
    df: DataFrame,
    from_col: str | Column,
    to_col: str | Column,
    damping_factor: float = 0.85,
    max_iterations: int = 100,
    convergence_threshold: float = 1e-6,
    partition_by: Sequence[str | Column] = (),
    local_edges: int = RANKED_EDGES,
) -> DataFrame:
    """All columns of ``df`` and ``pagerank``: the score of the row's ``from``
    node (see ``page_rank_nodes``).

    The score is 0 where ``from`` is null or no complete row names it. Rows
    are kept, repeated ones too; an existing column ``pagerank`` (in any case)
    is replaced, and other columns may have any names. An empty table gives an
    empty table."""
    scopes = Scopes(df, partition_by)
    scores = _scores(scopes, df, from_col, to_col, damping_factor, max_iterations, convergence_threshold, False, local_edges)
    start, node, score = free_names(df.columns, "start", "node", "score")
    kept = [c for c in df.columns if c.lower() != "pagerank"]
    placed = df.withColumn(start, scopes.inside(named(from_col).cast("string")))
    joined = placed.join(scores.select(F.col("node").alias(node), F.col("score").alias(score)), F.col(start) == F.col(node), "left")
    return joined.select(*(named(c) for c in kept), F.coalesce(F.col(score), F.lit(0.0)).alias("pagerank"))
