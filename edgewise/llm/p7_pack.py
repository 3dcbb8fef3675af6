"""Filling fixed-capacity containers with items, by minimum bin slack.

Items are spread over shards of about ``shard_containers`` containers each by a
hash; a shard is packed by one task, so the space that its last container
leaves is shared by a thousand others. In a shard each container starts with
the largest item left; a bitset of reachable sums (one bit for each fill) is
grown over the lengths left, largest first and with their multiplicities
split into powers of two, until the container is exactly full or all lengths
have been seen; the highest reachable sum is backtracked to the counts of each
length. The same multiset is used again for as long as enough items of each
length are left.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.llm.sizes import byte_tokens


def fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of ``counts`` (length to number left; ``lengths`` are its
    keys, descending) that holds the largest length and fills ``capacity`` as
    closely as any; of equal fills the one that larger lengths reach first."""
    seed = lengths[0]
    target = capacity - seed
    used = {seed: 1}
    if target == 0:
        return used
    mask, full = (1 << (target + 1)) - 1, 1 << target
    reach, steps = 1, []
    for length in lengths:
        if length > target:
            continue
        left = min(counts[length] - (length == seed), target // length)
        many = 1
        while left > 0:
            many = min(many, left)
            grown = reach | (reach << (many * length)) & mask
            if grown != reach:
                steps.append((length, many, reach))
                reach = grown
                if reach & full:
                    break
            left -= many
            many *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + many
            at -= many * length
    return used


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, 2 ...) of each of the sizes, which are 1 to
    ``capacity``; 0-sized ones go to the first container."""
    out = np.zeros(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    values, starts = np.unique(sizes[order], return_index=True)
    ends = np.r_[starts[1:], len(order)]
    next_of = {int(v): int(s) for v, s in zip(values, starts) if v > 0}
    counts = {int(v): int(e - s) for v, s, e in zip(values, starts, ends) if v > 0}
    lengths, container = sorted(counts, reverse=True), 0
    while lengths:
        used = fill(lengths, counts, capacity)
        again = min(counts[length] // n for length, n in used.items())
        for length, n in used.items():
            at = next_of[length]
            out[order[at : at + n * again]] = container + np.arange(n * again) // n
            next_of[length] = at + n * again
            counts[length] -= n * again
        container += again
        if any(not counts[length] for length in used):
            lengths = [length for length in lengths if counts[length]]
    return out


def _pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = table["length"].to_numpy()
        return table.append_column("place", pa.array(pack(sizes, capacity)))

    return run


def fill_containers(df: DataFrame, key_col: str = "doc_id", size: Column | None = None, capacity: int = 8192, shard_containers: int = 1024) -> DataFrame:
    """``(key, piece, pieces, start, length, container)``: one row for each
    item, or for each piece of an item that is larger than ``capacity``; the
    rows of a ``container`` have at most ``capacity`` in all.

    ``size`` is the items' size, by default the byte tokens of ``text``. An
    item without a size (null) isn't packed. An item larger than a container
    is split into full containers and a rest, which is packed like any other
    item; nothing else is split. Rows are items of their own, also where keys
    are null or repeat. An empty table gives no row. The container's number
    is unique in the result; it has no other meaning.

    ``shard_containers``: containers that one task fills at a time. The number
    of shards follows the total size, so a shard has at most about that many
    times ``capacity`` tokens, however many rows there are."""
    sized = df.select(F.col(f"`{key_col}`").alias("key"), (size if size is not None else byte_tokens("text")).cast("bigint").alias("size")).filter("size is not null")
    total = sized.agg(F.sum("size").alias("total")).first()["total"] or 0
    shards = max(1, -(-total // (capacity * shard_containers)))
    full = F.floor((F.col("size") - 1) / F.lit(capacity)).cast("bigint")
    # Pieces 0 .. full-1 fill a container each; the last piece has what is left.
    pieces = F.when(F.col("size") <= capacity, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), full))
    salted = sized.select("key", "size", F.explode(pieces).alias("piece"), F.when(F.col("size") <= capacity, F.lit(1)).otherwise(full + 1).cast("bigint").alias("pieces"))
    rows = salted.select(
        "key", "piece", "pieces", (F.col("piece") * capacity).alias("start"),
        F.when(F.col("pieces") == 1, F.col("size")).when(F.col("piece") < F.col("pieces") - 1, F.lit(capacity)).otherwise(F.col("size") - F.col("piece") * capacity).cast("bigint").alias("length"),
    ).withColumn("shard", F.pmod(F.xxhash64("key", "piece", F.rand(7)), F.lit(shards)))
    key_type = dict(sized.dtypes)["key"]
    schema = f"key {key_type}, piece bigint, pieces bigint, start bigint, length bigint, shard bigint, place bigint"
    # Packing costs much more time than the few bytes of its input tell, so the shards are spread by number, not merged by size.
    tasks = min(shards, 64 * df.sparkSession.sparkContext.defaultParallelism)
    packed = rows.repartition(tasks, "shard").groupBy("shard").applyInArrow(_pack_shard(capacity), schema)
    return packed.select("key", "piece", "pieces", "start", "length", (F.col("shard") * F.lit(1 << 32) + F.col("place")).alias("container"))


def container_use(packed: DataFrame, capacity: int = 8192) -> DataFrame:
    """``(containers, tokens, unused, fill)`` of ``fill_containers``' result."""
    each = packed.groupBy("container").agg(F.sum("length").alias("used"))
    return each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens")).select(
        "containers", "tokens", (F.col("containers") * capacity - F.col("tokens")).alias("unused"), F.try_divide("tokens", F.col("containers") * F.lit(float(capacity))).alias("fill")
    )
