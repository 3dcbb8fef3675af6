"""Most frequent items among billions, by a three-phase threshold top-k.

The nodes are the input splits: each counts its own items once (bounded by the
split, no shuffle) and writes them. The phases then read those counts:

1. each node's ``k`` leaders are added up; the k-th largest of these partial
   sums is a lower bound of the k-th largest count,
2. only local counts of at least the bound's share (bound / nodes) are
   fetched: an item below it everywhere can't reach the bound. The partial
   sums give a better bound, and items whose sum can't reach it even if every
   node that didn't report them holds just under the share fall away,
3. the counts of the items left are fetched from all nodes and added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.functions import clean_value
from edgewise.store import write_table

LOCAL = "node int, item string, n bigint, place int"


def _local_counts(k: int):
    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("item").aggregate([("n", "sum")]).rename_columns(["item", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            counted = pc.value_counts(batch.column(0).drop_null())
            parts.append(pa.table({"item": counted.field(0), "n": counted.field(1)}))
            rows += len(counted)
            if rows > 1_000_000:  # merge now and then, so that at most the distinct items of the split are held
                parts = [merged(parts)]
                rows = 0
        if not parts:
            return
        table = merged(parts)
        order = pc.select_k_unstable(table, min(k, len(table)), [("n", "descending"), ("item", "ascending")]) if len(table) else pa.array([], pa.int64())
        place = [None] * len(table)
        for i, at in enumerate(order.to_pylist()):
            place[at] = i + 1
        node = TaskContext.get().partitionId()
        out = pa.table({"node": pa.array([node] * len(table), pa.int32()), "item": table["item"].cast(pa.string()), "n": table["n"].cast(pa.int64()), "place": pa.array(place, pa.int32())})
        yield from out.to_batches(max_chunksize=65_536)

    return run


def frequent_items(df: DataFrame, item_col: str = "item_id", k: int = 200) -> DataFrame:
    """``(item, n, total)``: the ``k`` items with the most rows, their exact
    numbers of rows and the number of rows of all items.

    Items are clean values; rows whose item is missing (null, empty, ``N/A``)
    count nowhere. Of items that tie for the last place those that come first
    by bytes are taken. Fewer than ``k`` distinct items give all of them, an
    empty table gives no row. Repeated rows count each time. Memory is bounded
    by the distinct items of one input split; the driver gets three numbers."""
    local = write_table(df.select(clean_value(F.col(f"`{item_col}`")).alias("item")).filter("item is not null").mapInArrow(_local_counts(k), LOCAL), "local-counts")
    about = local.agg(F.countDistinct("node").alias("nodes"), F.sum("n").alias("total")).first()
    nodes, total = about["nodes"], about["total"]
    empty = local.select("item", "n", F.lit(0).cast("bigint").alias("total"))
    if not nodes:
        return empty
    bound = _kth(local.filter(F.col("place") <= k).groupBy("item").agg(F.sum("n").alias("n")), k)
    share = bound / nodes
    seen = local.filter(F.col("n") >= F.lit(share)).groupBy("item").agg(F.sum("n").alias("n"), F.count("*").alias("reports"))
    better = max(bound, _kth(seen, k))
    candidates = seen.filter(F.col("n") + (F.lit(nodes) - F.col("reports")) * F.lit(share) >= better).select("item")
    exact = local.join(candidates, "item", "left_semi").groupBy("item").agg(F.sum("n").alias("n"))
    return exact.orderBy(F.desc("n"), "item").limit(k).withColumn("total", F.lit(total).cast("bigint"))


def _kth(sums: DataFrame, k: int) -> int:
    """The k-th largest ``n``, or 0 if there are fewer rows."""
    row = sums.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("n"), F.count("*").alias("rows")).first()
    return row["n"] if row["rows"] == k else 0
