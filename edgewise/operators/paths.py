"""All-pairs shortest distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.model import MILLI, Scopes, checked_weight, edge_rows, named, node_list
from edgewise.operators.components import NodeIds
from edgewise.operators.small_graphs import LOCAL_EDGES, LOCAL_PAIRS, from_every_node, shortest_paths
from edgewise.store import append_table, drop, new_path, write_table


def calculate_shortest_path(
    df: DataFrame,
    from_col: str | Column,
    to_col: str | Column,
    weight_col: str | Column,
    directed: bool = False,
    duplicate_pairs: bool = False,
    max_rounds: int = 100_000,
    local_edges: int = LOCAL_EDGES,
    partition_by: Sequence[str | Column] = (),
) -> DataFrame:
    """``(from, to, distance)`` for every pair of different nodes of which one
    reaches the other.

    Columns may be names or expressions. Undirected edges can be walked both
    ways, and a pair comes once, with ``from`` before ``to`` by bytes; directed
    pairs come once for each direction that has a path (twice with
    ``duplicate_pairs``). Weights are cut to thousandths; of parallel edges the
    cheapest counts, loops never do. A row with a null end or weight takes no
    part; a negative, NaN or infinite weight raises an error. Weights that
    aren't numbers are null. An empty table gives no row; other columns are not
    read. With ``partition_by``, each combination of its values is a graph of
    its own, and the values come first in the result.

    The relaxation is semi-naive: only the distances that the last round
    improved are joined to the edges, each candidate is reduced to the least
    for its pair before it meets the distances known, and only improved
    distances are written, as further rows of one table. The result has up to
    one row for each pair of nodes. With at most ``local_edges`` merged edges
    and 50 million pairs of nodes (both counted), each task relaxes its share
    of the start nodes in arrays instead."""
    scopes = Scopes(df, partition_by)
    complete = named(from_col).isNotNull() & named(to_col).isNotNull()
    rows = edge_rows(df, from_col, to_col, checked_weight(named(weight_col), complete).alias("w"), scopes=scopes).filter("w is not null")
    if not directed:
        ends = F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        rows = rows.select(F.explode(ends).alias("x")).select("x.*")
    edges = write_table(rows.filter("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")), "sp-edges")
    size = edges.agg(F.count("*").alias("n"), F.max("w").alias("longest")).first()
    nodes = node_list(edges).count() if 0 < size["n"] <= local_edges else 0
    if nodes and nodes**2 <= LOCAL_PAIRS and size["longest"] < (1 << 62) // (2 * size["n"]):
        found = from_every_node(edges, size["n"], nodes, shortest_paths(directed), ["src", "dst", "w"], "src string, dst string, cost bigint")
        return _named(scopes, found, directed and duplicate_pairs)
    # The rounds run on ids; names come back at the end.
    names = write_table(node_list(edges), "sp-nodes")
    ids = NodeIds.of(names)
    coded = write_table(ids.add(edges, s="src", t="dst").select(F.col("s").alias("src"), F.col("t").alias("dst"), "w"), "sp-coded")
    drop(edges)
    step = coded.select(F.col("src").alias("mid"), F.col("dst").alias("end"), "w")
    path = new_path(df.sparkSession, "sp-known")
    known = append_table(coded.select("src", "dst", F.col("w").alias("cost"), F.lit(0).alias("round")), path)
    for k in range(max_rounds):
        moving = known.filter(F.col("round") == k).select("src", F.col("dst").alias("mid"), "cost")
        longer = moving.join(step, "mid").filter("src <> end").groupBy("src", F.col("end").alias("dst")).agg(F.min(F.col("cost") + F.col("w")).alias("cost"))
        # Known and candidate distances of a pair meet in one group; a candidate that is less than all of them is a row more.
        met = known.select("src", "dst", F.col("cost").alias("old"), F.lit(None).cast("bigint").alias("try")).unionAll(longer.select("src", "dst", F.lit(None).cast("bigint").alias("old"), F.col("cost").alias("try")))
        best = met.groupBy("src", "dst").agg(F.min("old").alias("old"), F.min("try").alias("try"))
        improved = best.filter("try is not null and (old is null or try < old)")
        known = append_table(improved.select("src", "dst", F.col("try").alias("cost"), F.lit(k + 1).alias("round")), path)
        if known.filter(F.col("round") == k + 1).isEmpty():
            break
    drop(coded)
    pairs = (known if directed else known.filter("src < dst")).groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    placed = ids.add(names, id="node")
    at = lambda end: placed.select(F.col("id").alias(end), F.col("node").alias(f"name_{end}"))
    spelled = pairs.join(at("src"), "src").join(at("dst"), "dst")
    # An undirected pair has the smaller name first, whatever its ids.
    first, second = (F.col("name_src"), F.col("name_dst")) if directed else (F.least("name_src", "name_dst"), F.greatest("name_src", "name_dst"))
    return _named(scopes, spelled.select(first.alias("src"), second.alias("dst"), "cost"), directed and duplicate_pairs)


def _named(scopes: Scopes, pairs: DataFrame, twice: bool) -> DataFrame:
    ends = (scopes.bare(F.col(c)).alias(a) for c, a in (("src", "from"), ("dst", "to")))
    out = scopes.named_rows(pairs, scopes.of(F.col("src")), *ends, (F.col("cost") / F.lit(MILLI)).alias("distance"))
    return out.unionAll(out) if twice else out
