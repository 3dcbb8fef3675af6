"""Queries of the core: name to (session, folder of the tables) -> frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions import clean_value
from edgewise.operators.betweenness import betweenness_centrality
from edgewise.operators.components import graph_solver, super_merger, super_merger_weighted
from edgewise.operators.key_counts import counts_per_key, hot_keys
from edgewise.operators.pagerank import page_rank, page_rank_nodes
from edgewise.operators.paths import calculate_shortest_path
from edgewise.operators.rules import graph_association_rules
from edgewise.sources import read_table
from edgewise.store import write_table

ROUND = 9


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_super_merger_weighted(spark, sf_dir)


def edges_graph_solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all rows, numbered by the smallest name of each group."""
    return graph_solver(read_table(spark, sf_dir, "edges"), "from", "to").select("pos", "group")


def edges_super_merger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all rows, numbered by first appearance."""
    return super_merger(read_table(spark, sf_dir, "edges"), "from", "to", order_by="pos").select("pos", "value", "group")


def edges_super_merger_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_merger_weighted(read_table(spark, sf_dir, "edges"), "from", "to", "weight", 0.7, order_by="pos").select("pos", "group")


def edges_super_merger_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of ``seen_at`` is a graph of its own."""
    edges = read_table(spark, sf_dir, "edges").withColumn("day", F.to_date("seen_at"))
    return super_merger(edges, "from", "to", order_by="pos", partition_by=["day"]).select("pos", "day", "group")


def routes_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = page_rank(read_table(spark, sf_dir, "routes"), "from", "to")
    return ranked.select("from", "to", "weight", F.round("pagerank", ROUND).alias("pagerank"))


def routes_page_rank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rank_nodes(read_table(spark, sf_dir, "routes"), "from", "to").select("node", F.round("score", ROUND).alias("score"), "iterations")


def edges_page_rank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten iterations over all edges."""
    scores = page_rank_nodes(read_table(spark, sf_dir, "edges"), "from", "to", max_iterations=10, convergence_threshold=0.0)
    return scores.select("node", F.round("score", ROUND).alias("score"), "iterations")


def edges_page_rank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges, until the scores converge (the operator's own limits)."""
    return page_rank_nodes(read_table(spark, sf_dir, "edges"), "from", "to").select("node", F.round("score", ROUND).alias("score"), "iterations")


def edges_page_rank_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the loop over tables that larger graphs take."""
    return page_rank_nodes(read_table(spark, sf_dir, "edges"), "from", "to", local_edges=0).select("node", F.round("score", ROUND).alias("score"), "iterations")


def edges_page_rank_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month of loading is a graph of its own, with its own end."""
    month = F.date_format("loaded_at", "yyyy-MM")
    scores = page_rank_nodes(read_table(spark, sf_dir, "edges"), "from", "to", local_edges=0, partition_by=[month])
    return scores.select(F.col("key0").alias("month"), "node", F.round("score", ROUND).alias("score"), "iterations")


def _long() -> Column:
    """Routes of at least this weight, and all others, as two graphs."""
    return F.coalesce(F.col("weight") >= 5, F.lit(False))


def routes_page_rank_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = page_rank_nodes(read_table(spark, sf_dir, "routes"), "from", "to", partition_by=[_long()])
    return scores.select(F.col("key0").alias("long"), "node", F.round("score", ROUND).alias("score"), "iterations")


def routes_paths_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculate_shortest_path(read_table(spark, sf_dir, "routes"), "from", "to", "weight")


def routes_paths_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculate_shortest_path(read_table(spark, sf_dir, "routes"), "from", "to", "weight", directed=True)


def routes_paths_undirected_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the loop over tables that larger graphs take."""
    return calculate_shortest_path(read_table(spark, sf_dir, "routes"), "from", "to", "weight", local_edges=0)


def routes_paths_directed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculate_shortest_path(read_table(spark, sf_dir, "routes"), "from", "to", "weight", directed=True, local_edges=0)


def routes_paths_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calculate_shortest_path(read_table(spark, sf_dir, "routes"), "from", "to", "weight", directed=True, partition_by=[_long()])
    return found.withColumnRenamed("key0", "long")


def _centrality(spark: SparkSession, sf_dir: str, normalized: bool, directed: bool, **options) -> DataFrame:
    found = betweenness_centrality(read_table(spark, sf_dir, "routes"), "from", "to", normalized, directed, **options)
    return found.withColumn("centrality", F.round("centrality", ROUND))


def routes_betweenness_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centrality(spark, sf_dir, True, False)


def routes_betweenness_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centrality(spark, sf_dir, True, True)


def routes_betweenness_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centrality(spark, sf_dir, False, True)


def routes_betweenness_undirected_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the loop over tables that larger graphs take."""
    return _centrality(spark, sf_dir, True, False, local_edges=0)


def routes_betweenness_directed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centrality(spark, sf_dir, True, True, local_edges=0)


def routes_betweenness_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centrality(spark, sf_dir, True, False, partition_by=[_long()]).withColumnRenamed("key0", "long")


def _rounded(rules: DataFrame, *keys: Column, digits: int = ROUND) -> DataFrame:
    scores = F.transform("confidence_scores", lambda x: F.format_string("%.9f", F.round(x, ROUND)))
    return rules.select(*keys, "item", F.round("support", 6).alias("support"), F.round("lift_score", digits).alias("lift_score"), "pattern", F.array_join("consequents", "|").alias("consequents"), F.array_join(scores, "|").alias("confidence_scores"))


def transactions_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of all transactions, items numbered by name."""
    return _rounded(graph_association_rules(read_table(spark, sf_dir, "transactions"), "transaction_id", "item_id", min_support=0.005, min_confidence=0.005))


def transactions_rules_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph_association_rules(read_table(spark, sf_dir, "transactions"), "transaction_id", "item_id"))


def _weighted(rows: DataFrame, min_support: float = 0.005, **options) -> DataFrame:
    """Weighted by frequency; items numbered by first appearance."""
    return graph_association_rules(rows, "transaction_id", "item_id", "frequency", min_support=min_support, min_confidence=0.005, weighted=True, order_by="pos", **options)


def _with_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "transactions").filter("frequency is null or not isnan(frequency)")


def transactions_rules_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows whose frequency isn't NaN."""
    return _rounded(_weighted(_with_number(spark, sf_dir)))


def transactions_rules_weighted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all rows: a NaN frequency makes its item's sum NaN, which isn't frequent."""
    return _rounded(_weighted(read_table(spark, sf_dir, "transactions"), 0.0001))


def transactions_rules_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month of arrival is a set of transactions of its own."""
    rules = _weighted(_with_number(spark, sf_dir), partition_by=[F.date_format("ingested_at", "yyyy-MM")])
    return _rounded(rules, F.col("key0").alias("month"))


def lineitem_rules_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order; orders of more than eight lines give no entries."""
    rules = graph_association_rules(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", min_support=0.0001, min_confidence=0.0001, max_itemset_size=8)
    return _rounded(rules, digits=6)


def _node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_table(spark, sf_dir, "edges")
    return counts_per_key(edges, [clean_value(F.col("from")), clean_value(F.col("to"))], ["n_from", "n_to"], key="node")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_counts(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = write_table(_node_counts(spark, sf_dir), "node-counts")
    return hot_keys(counts, "node", ["n_from", "n_to"], 1 / 50).select(F.substring("side", 3, 4).alias("side"), "node")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p3_found, p3_counts, edges_graph_solver, edges_super_merger, edges_super_merger_weighted, edges_super_merger_by_day,
        routes_page_rank, routes_page_rank_nodes, routes_page_rank_by_length, edges_page_rank_nodes, edges_page_rank_converged, edges_page_rank_tables, edges_page_rank_by_month,
        routes_paths_undirected, routes_paths_directed, routes_paths_undirected_tables, routes_paths_directed_tables, routes_paths_by_length,
        routes_betweenness_undirected, routes_betweenness_directed, routes_betweenness_raw, routes_betweenness_undirected_tables, routes_betweenness_directed_tables, routes_betweenness_by_length,
        transactions_rules, transactions_rules_defaults, transactions_rules_weighted, transactions_rules_weighted_all, transactions_rules_by_month, lineitem_rules_capped,
    )
}
