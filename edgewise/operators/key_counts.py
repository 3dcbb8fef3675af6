"""Results per key where a few keys hold most records.

Dense accumulator arrays: each input split dictionary-encodes its keys, adds
its rows up with ``numpy.bincount`` over the codes, and cuts dictionary and
accumulators into blocks by a hash of the key. A hot key is one entry of one
block for each split, whatever its number of rows, so no task gets more than
the equal share of rows its split has. Blocks of the same number are then
summed by scatter-reduction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct keys that a split's accumulators may hold before they are sent on.
SPLIT_KEYS = 1_000_000
#: Estimated bytes of the columns for each accumulator block.
BLOCK_BYTES = 64 << 20


class _Accumulators:
    """Counts per key and side in dense arrays over one dictionary."""

    def __init__(self, sides: int) -> None:
        self.keys, self.counts, self.sides = pa.array([], pa.string()), np.zeros((sides, 0), np.int64), sides

    def add(self, keys: list[pa.Array], weights: list[np.ndarray | None]) -> None:
        """``keys[i]`` are keys of side i; nulls count nowhere."""
        joint = pa.concat_arrays([self.keys, *[k.drop_null() for k in keys]]).dictionary_encode()
        codes, dictionary = joint.indices.to_numpy(), joint.dictionary
        counts = np.zeros((self.sides, len(dictionary)), np.int64)
        counts[:, : self.counts.shape[1]] = self.counts  # the first codes are the keys held so far
        at = len(self.keys)
        for side, (k, w) in enumerate(zip(keys, weights)):
            n = len(k) - k.null_count
            own = codes[at : at + n]
            counts[side] += np.bincount(own, minlength=len(dictionary)) if w is None else np.bincount(own, w, len(dictionary)).astype(np.int64)
            at += n
        self.keys, self.counts = dictionary, counts


def _split_counts(sides: int, split_keys: int):
    def flush(acc: _Accumulators) -> Iterator[pa.RecordBatch]:
        out = {"key": acc.keys} | {f"n{i}": pa.array(acc.counts[i]) for i in range(sides)}
        yield from pa.table(out).to_batches(max_chunksize=65_536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, held, rows = _Accumulators(sides), [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                yield from fold(acc, held)
                held, rows = [], 0
                if len(acc.keys) > split_keys:
                    yield from flush(acc)
                    acc = _Accumulators(sides)
        yield from fold(acc, held)
        if len(acc.keys):
            yield from flush(acc)

    def fold(acc: _Accumulators, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            table = pa.Table.from_batches(held)
            acc.add([table.column(i).combine_chunks().cast(pa.string()) for i in range(sides)], [None] * sides)
        return iter(())

    return run


def _block_sums(sides: int):
    """Scatter-reduces the splits' entries of one block; a partition holds one
    block or several, and at most their distinct keys at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, rows = pa.array([], pa.string()), np.zeros((sides, 0), np.int64), [], 0

        def fold() -> None:
            nonlocal keys, counts, held, rows
            if not held:
                return
            table = pa.Table.from_batches(held)
            joint = pa.concat_arrays([keys, table["key"].combine_chunks().cast(pa.string())]).dictionary_encode()
            codes, n = joint.indices.to_numpy(), len(joint.dictionary)
            summed = np.zeros((sides, n), np.int64)
            summed[:, : counts.shape[1]] = counts
            for i in range(sides):
                np.add.at(summed[i], codes[len(keys) :], table[f"n{i}"].to_numpy())
            keys, counts, held, rows = joint.dictionary, summed, [], 0

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                fold()
        fold()
        if len(keys):
            yield from pa.table({"key": keys} | {f"n{i}": pa.array(counts[i]) for i in range(sides)}).to_batches(max_chunksize=65_536)

    return run


def _estimated_bytes(df: DataFrame) -> int:
    """By the optimiser, without running anything; 0 where it can't tell (it then says more than any table has)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def counts_per_key(df: DataFrame, columns: Sequence[Column], names: Sequence[str], key: str = "key", blocks: int | None = None, split_keys: int = SPLIT_KEYS) -> DataFrame:
    """``(key, names...)``: for every value of the string columns ``columns``,
    its number of rows in each of them.

    Nulls count nowhere; a value that only one column has gets 0 in the
    others. Repeated rows count each time, an empty table gives no row, and
    only ``columns`` are read. No task depends on how often a key occurs: a
    split's work is its rows, a block's work is its distinct keys times the
    splits that have them. ``blocks``: the number of accumulator blocks, by
    default the session's shuffle partitions, or one for each ``BLOCK_BYTES`` of
    the columns by the optimiser's estimate if that is more, so that a block's
    keys fit a task whatever their number."""
    sides = len(columns)
    schema = "key string, " + ", ".join(f"n{i} bigint" for i in range(sides))
    picked = df.select(*(c.cast("string").alias(f"c{i}") for i, c in enumerate(columns)))
    entries = picked.mapInArrow(_split_counts(sides, split_keys), schema)
    n = blocks or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _estimated_bytes(picked) // BLOCK_BYTES)
    summed = entries.repartition(n, "key").mapInArrow(_block_sums(sides), schema)
    return summed.select(F.col("key").alias(key), *(F.col(f"n{i}").alias(name) for i, name in enumerate(names)))


def hot_keys(counts: DataFrame, key: str, names: Sequence[str], least_share: float) -> DataFrame:
    """``(side, key, n, total)`` of ``counts_per_key``'s result: the keys that
    hold at least ``least_share`` (a fraction 1/m of whole m) of a side's
    counted rows. The sides' totals are sums over ``counts``, one row that is
    broadcast."""
    whole = round(1 / least_share)
    totals = counts.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(f"_total_{n}") for n in names))
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(n).alias("n"), F.col(f"_total_{n}").alias("total")) for n in names)))
    return counts.crossJoin(F.broadcast(totals)).select(F.col(key), sides.alias("x")).select("x.side", key, "x.n", "x.total").filter((F.col("n") > 0) & (F.col("n") * whole >= F.col("total")))
