"""Items that appear together, by a blocked Gram matrix.

With X the binary matrix of baskets and items, the shared baskets of all pairs
are the upper triangle of XᵀX. It is computed from blocks:

* Items that can't be in a pair of the result leave X first, exactly: a pair's
  shared baskets are at most the baskets of either item, so an item needs at
  least ``min_common`` of them, and at most 1/``min_lift`` of all (else the
  shared baskets can't exceed chance as asked).
* The items left are numbered by falling frequency and cut into blocks of
  ``item_block``: most of a basket's items lie in the first blocks, so baskets
  have few blocks. A basket is a list of items for each block that it has, and
  the lists go only to the pairs of those blocks.
* A pair of item blocks is cut into record blocks by the number of baskets
  that can be in both. Of each, the transpose-product of the two sparse blocks
  is summed up in one task, by outer products of the lists or, where they fill
  a good part of the block, as a product of dense matrices. It gives out one
  count for each pair of items that it has, at most ``item_block``², however
  many baskets there are; a pair of blocks with a single record block gives
  out only counts that reach ``min_common``.

The counts are summed over the record blocks and compared with the product of
the items' marginals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.functions import clean_value
from edgewise.model import named
from edgewise.operators.components import NodeIds, number_rows
from edgewise.store import drop, write_table

#: Items of an item block, and baskets of a record block.
ITEM_BLOCK, RECORD_BLOCK = 2048, 65_536
#: Pairs that a task expands before it sums them up.
PAIRS_AT_ONCE = 2_000_000
#: A product is dense if its lists have at least this share of all pairs of the block's baskets and items; then it takes fewer operations.
DENSE_SHARE = 1 / 64
#: Ids, or blocks, that are broadcast if there are counted to be no more.
BROADCAST_IDS = 500_000


class _Lists:
    """Lists of items: the list of row r is ``items[start[r] : start[r] + size[r]]``."""

    def __init__(self, column: pa.ListArray) -> None:
        self.items = pc.list_flatten(column).to_numpy().astype(np.int64)
        self.size = pc.list_value_length(column).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.size) - self.size

    def positions(self, lo: int, hi: int) -> slice:
        return slice(self.start[lo], self.start[hi - 1] + self.size[hi - 1]) if hi > lo else slice(0, 0)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.int64)


def _outer(left: _Lists, right: _Lists, lo: int, hi: int) -> np.ndarray:
    """Keys (smaller item << 32 | larger item) of all pairs of the lists of rows lo to hi."""
    own = left.items[left.positions(lo, hi)]
    rows = np.repeat(np.arange(lo, hi), left.size[lo:hi])
    many = right.size[rows]
    at = np.repeat(right.start[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    a, b = np.repeat(own, many), right.items[at]
    keep = a < b
    return a[keep] << 32 | b[keep]


def _dense(left: _Lists, right: _Lists, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a product of dense matrices."""
    (ia, a), (ib, b) = (np.unique(x.items[x.positions(lo, hi)], return_inverse=True) for x in (left, right))
    rows = [np.repeat(np.arange(hi - lo), x.size[lo:hi]) for x in (left, right)]
    gram = np.zeros((len(ia), len(ib)), np.int64)
    for at in range(0, hi - lo, 4096):
        x = [np.zeros((min(4096, hi - lo - at), len(i)), np.float32) for i in (ia, ib)]
        for block, r, k in zip(x, rows, (a, b)):
            own = slice(*np.searchsorted(r, (at, at + 4096)))
            block[r[own] - at, k[own]] = 1
        gram += (x[0].T @ x[1]).astype(np.int64)
    i, j = np.nonzero(gram)
    keep = ia[i] < ib[j]
    return (ia[i] << 32 | ib[j])[keep], gram[i, j][keep]


def _products(min_common: int, pairs_at_once: int, dense_share: float):
    """(bi, bj, rb, whole, ci, cj), sorted by the first three, to (pair, n)."""

    def chunk(table: pa.Table) -> tuple[list, list, list]:
        """Group of each row, and keys and counts by group, summed within the chunk."""
        left, right = (_Lists(table[c].combine_chunks()) for c in ("ci", "cj"))
        ids = np.stack([table[c].to_numpy() for c in ("bi", "bj", "rb")])
        cuts = np.r_[0, np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, table.num_rows]
        wholes, out = table["whole"].to_numpy(zero_copy_only=False), []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            work = left.size[lo:hi] * right.size[lo:hi]
            items = [np.unique(x.items[x.positions(lo, hi)]).size for x in (left, right)] if work.sum() > 4096 else [0, 0]
            if work.sum() > 4096 and work.sum() >= dense_share * (hi - lo) * items[0] * items[1]:
                keys, counts = _dense(left, right, lo, hi)
            else:
                keys, counts = [], []
                at = lo
                while at < hi:
                    # As many rows as expand to no more than the bound, one at least.
                    to = at + max(1, int(np.searchsorted(np.cumsum(work[at - lo :]), pairs_at_once, "right")))
                    keys.append(_outer(left, right, at, to))
                    counts.append(np.ones(len(keys[-1])))
                    if len(keys) > 1:
                        keys, counts = ([x] for x in _summed(keys, counts))
                    at = to
                keys, counts = _summed(keys, counts)
            out.append((tuple(ids[:, lo]), bool(wholes[lo]), keys, counts))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        open_key, open_whole, open_keys, open_counts = None, False, [], []

        def fold(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal open_key, open_whole, open_keys, open_counts
            ready = []
            for key, whole, keys, counts in chunk(table):
                if key != open_key:
                    ready.append(close())
                    open_key, open_whole, open_keys, open_counts = key, whole, [], []
                open_keys.append(keys)
                open_counts.append(counts)
                if len(open_keys) > 1:
                    open_keys, open_counts = ([x] for x in _summed(open_keys, open_counts))
            yield from give(ready)

        def close() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = _summed(open_keys, open_counts)
            keep = counts >= (min_common if open_whole else 1)
            return keys[keep], counts[keep]

        def give(ready: list) -> Iterator[pa.RecordBatch]:
            if ready:
                yield from pa.table({"pair": np.concatenate([k for k, _ in ready]), "n": np.concatenate([c for _, c in ready])}).to_batches(max_chunksize=65_536)

        for batch in batches:
            held.append(batch)
            cells += len(batch["ci"].flatten()) + len(batch["cj"].flatten())
            if cells >= pairs_at_once:
                yield from fold(pa.Table.from_batches(held))
                held, cells = [], 0
        if held:
            yield from fold(pa.Table.from_batches(held))
        yield from give([close()])

    return run


def _limited(frame: DataFrame, size: int, broadcast_ids: int) -> DataFrame:
    return F.broadcast(frame) if size <= broadcast_ids else frame


def pairs_together(
    df: DataFrame,
    record_col: str | Column = "transaction_id",
    item_col: str | Column = "item_id",
    min_common: int = 5,
    min_lift: int = 5,
    item_block: int = ITEM_BLOCK,
    record_block: int = RECORD_BLOCK,
    broadcast_ids: int = BROADCAST_IDS,
    pairs_at_once: int = PAIRS_AT_ONCE,
    dense_share: float = DENSE_SHARE,
) -> DataFrame:
    """``(item_a, item_b, common, n_a, n_b, n_all, lift)`` of the pairs in at
    least ``min_common`` common baskets for which common * all >= ``min_lift``
    * n_a * n_b, in whole numbers; ``item_a < item_b`` by bytes, ``lift`` is
    common * all / (n_a * n_b).

    A basket is a distinct record with at least one row whose item isn't
    missing; items are clean values. An item that a basket has several times
    counts once, and so do repeated rows. Rows without a record or an item
    count nowhere. An empty table gives no row; other columns aren't read.

    No basket is collected whole, and none is left out: a basket is a row for
    each of its item blocks, of at most ``item_block`` items, and a huge one's
    rows spread over the pairs of its blocks like any other's. A record block
    has about ``record_block`` baskets. ``pairs_at_once`` bounds what a task
    holds before it sums up; ``dense_share`` only chooses between two ways to
    the same product."""
    spark = df.sparkSession
    rows = df.select(named(record_col).try_cast("bigint").alias("record"), clean_value(named(item_col)).alias("item")).filter("record is not null and item is not null")
    names = write_table(rows.select("item").distinct(), "names")
    ids = NodeIds.of(names, "item")
    cells = write_table(ids.add(rows, id="item").select("record", "id").distinct(), "cells")
    everything = cells.select("record").distinct().count()
    marginals = cells.groupBy("id").agg(F.count("*").alias("n"))
    possible = marginals.filter((F.col("n") >= min_common) & (F.col("n") * min_lift <= everything))
    ranked = ids.add(names, id="item").join(possible, "id").withColumn("place", F.struct((-F.col("n")).alias("n"), "item"))
    items = write_table(number_rows(ranked, [], "place", "code").select("id", "item", "n", (F.col("code") - 1).alias("code")), "items")
    n_items = items.count()
    codes = items.select("id", F.col("code").cast("int").alias("code"))
    live = cells.join(_limited(codes, n_items, broadcast_ids), "id").select("record", "code")
    lists = write_table(live.groupBy("record", F.floor(F.col("code") / item_block).cast("int").alias("block")).agg(F.sort_array(F.collect_list("code")).alias("codes")), "lists")
    drop(cells, names)
    products = _block_pairs(lists, -(-n_items // item_block), record_block, broadcast_ids)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = products.repartition(parts, "bi", "bj", "rb").sortWithinPartitions("bi", "bj", "rb").mapInArrow(_products(min_common, pairs_at_once, dense_share), "pair bigint, n bigint")
    common = counted.groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_common)
    frequent = common.select(F.shiftright("pair", 32).alias("x"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("y"), F.col("n").alias("common"))
    x = items.select(F.col("code").alias("x"), F.col("item").alias("item_x"), F.col("n").alias("n_x"))
    y = items.select(F.col("code").alias("y"), F.col("item").alias("item_y"), F.col("n").alias("n_y"))
    joined = frequent.join(x, "x").join(y, "y").withColumn("n_all", F.lit(everything).cast("bigint"))
    whole = lambda c: c.cast("decimal(19,0)")
    kept = joined.filter(whole(F.col("common")) * whole(F.col("n_all")) >= whole(F.col("n_x") * min_lift) * whole(F.col("n_y")))
    lift = F.col("common").cast("double") * F.col("n_all") / (F.col("n_x").cast("double") * F.col("n_y"))
    by_name = lambda x, y: F.when(F.col("item_x") < F.col("item_y"), F.col(x)).otherwise(F.col(y))
    return kept.select(
        by_name("item_x", "item_y").alias("item_a"), by_name("item_y", "item_x").alias("item_b"), "common", by_name("n_x", "n_y").alias("n_a"), by_name("n_y", "n_x").alias("n_b"), "n_all", lift.alias("lift")
    )


def _block_pairs(lists: DataFrame, blocks: int, record_block: int, broadcast_ids: int) -> DataFrame:
    """(bi, bj, rb, whole, ci, cj): the lists of each basket for each pair of
    blocks it has. A pair of blocks has as many record blocks as the baskets
    of the rarer of the two ask for; ``whole`` if that is one."""
    sizes = lists.groupBy("block").agg(F.count("*").alias("baskets"))
    sized = lists.join(_limited(sizes, blocks, broadcast_ids), "block")
    side = lambda k: sized.select("record", F.col("block").alias(f"b{k}"), F.col("codes").alias(f"c{k}"), F.col("baskets").alias(f"n{k}"))
    own = side("i").filter(F.size("ci") > 1).select("record", "bi", F.col("bi").alias("bj"), "ci", F.col("ci").alias("cj"), F.col("ni").alias("n"))
    across = side("i").join(side("j"), "record").filter("bi < bj").select("record", "bi", "bj", "ci", "cj", F.least("ni", "nj").alias("n"))
    parts = F.ceil(F.col("n") / record_block).cast("int")
    return own.unionAll(across).select("bi", "bj", F.pmod(F.xxhash64("record"), parts).cast("int").alias("rb"), (parts == 1).alias("whole"), "ci", "cj")
