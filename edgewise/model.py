"""What all graph and pattern operators do to their input first.

Nodes and items are compared as strings; weights and frequencies are doubles,
transaction ids are 64-bit integers. A value that can't be converted is null,
and a row with a null in any of its inputs takes no part (row-aligned results
still have it). Rows have no order in Spark: where a result depends on one
(numbering by first appearance), the caller names the columns to order by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thousandths: path weights are whole numbers of these.
MILLI = 1000.0


def named(column: str | Column) -> Column:
    """A column by its name, whatever it holds; an expression as it is."""
    return column if isinstance(column, Column) else F.col(f"`{column}`")


def edge_rows(df: DataFrame, from_col: str | Column, to_col: str | Column, *extra: Column, scopes: Scopes | None = None) -> DataFrame:
    """``(src, dst, extra...)`` of the rows with both ends given."""
    inside = scopes.inside if scopes else lambda name: name
    ends = (inside(named(c).cast("string")).alias(a) for c, a in ((from_col, "src"), (to_col, "dst")))
    return df.select(*ends, *extra).filter("src is not null and dst is not null")


class Scopes:
    """Graphs side by side: with ``partition_by``, each combination of its
    values is a graph of its own. Their vertices are kept apart by a prefix of
    the name, the values' texts with their lengths in base 64 and ``|``, so an
    operator runs over all graphs at once. Without keys names stay as they are."""

    def __init__(self, df: DataFrame, partition_by: Sequence[str | Column]) -> None:
        self.df, self.keys = df, [named(k) for k in partition_by]
        self.names = [k if isinstance(k, str) else f"key{i}" for i, k in enumerate(partition_by)]
        texts = [k.cast("string") for k in self.keys]
        self.prefix = F.concat(F.base64(F.encode(F.concat(*(F.coalesce(F.concat(F.length(k), F.lit(":"), k), F.lit("-")) for k in texts)), "UTF-8")), F.lit("|")) if self.keys else None

    def inside(self, name: Column) -> Column:
        """The name within all graphs; null if the name is."""
        return F.concat(self.prefix, name) if self.keys else name

    def of(self, name: Column) -> Column:
        """The graph of a name from ``inside``."""
        return F.substring_index(name, "|", 1) if self.keys else F.lit("")

    def bare(self, name: Column) -> Column:
        """The name as it was given."""
        return F.substr(name, F.instr(name, "|") + 1) if self.keys else name

    def named_rows(self, rows: DataFrame, graph: Column, *columns: Column) -> DataFrame:
        """(keys..., columns...) of ``rows``, whose graph is ``graph``."""
        if not self.keys:
            return rows.select(*columns)
        known = self.df.select(F.substring_index(self.prefix, "|", 1).alias("_graph"), *(k.alias(f"_key{i}") for i, k in enumerate(self.keys))).distinct()
        found = rows.withColumn("_own", graph).join(known, F.col("_own") == F.col("_graph"))
        return found.select(*(F.col(f"_key{i}").alias(n) for i, n in enumerate(self.names)), *columns)


def multiplicities(edges: DataFrame, directed: bool) -> DataFrame:
    """``(src, dst, mult)``: parallel edges as one row with their number; an
    undirected edge counts in both directions."""
    if not directed:
        ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        edges = edges.select(F.explode(ends).alias("x")).select("x.src", "x.dst")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("mult"))


def node_list(edges: DataFrame) -> DataFrame:
    """``(node)``: every node once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def checked_weight(weight: Column, complete: Column) -> Column:
    """Thousandths of a weight, cut off; null where the row isn't
    ``complete``. Negative, NaN and infinite weights of complete rows have no
    shortest path and raise an error."""
    w = weight.try_cast("double")
    bad = F.isnan(w) | (w < 0) | (w == float("inf"))
    # One expression, so that no order of filters can raise for a row that takes no part.
    return F.when(~complete | w.isNull(), F.lit(None).cast("bigint")).when(bad, F.raise_error(F.lit("weights must be finite and not negative")).cast("bigint")).otherwise((w * F.lit(MILLI)).cast("bigint"))


def transaction_rows(
    df: DataFrame, transaction_id: str | Column, item_id: str | Column, frequency: str | Column | None, order_by: str | Column | Sequence[str | Column] | None = None, *keys: Column
) -> DataFrame:
    """``(keys..., t, item, f, o...)`` of the rows with all inputs given."""
    order = [order_by] if isinstance(order_by, (str, Column)) else list(order_by or ())
    f = F.lit(1.0) if frequency is None else named(frequency).try_cast("double")
    return df.select(
        *keys, named(transaction_id).try_cast("bigint").alias("t"), named(item_id).cast("string").alias("item"), f.alias("f"), *(named(c).alias(f"o{i}") for i, c in enumerate(order))
    ).filter("t is not null and item is not null and f is not null")
