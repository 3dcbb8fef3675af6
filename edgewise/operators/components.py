"""Connected components: ``graph_solver``, ``super_merger`` and
``super_merger_weighted``, and the label loop they share.

The loop is *minimum propagation by contraction*. In each round every vertex
takes the smallest id among itself and its neighbours as its parent, edges are
rewritten to parents, loops and repeated edges fall away. The mapping keeps
connectivity (an edge ``v - parent(v)`` is rewritten to ``parent(v) -
parent(parent(v))``), and with hashed ids about two thirds of a chain's
vertices vanish in each round, so that the rounds grow with the logarithm of
the longest path and all rounds together cost a small multiple of the first.
At the end the parents of the rounds are composed from the last to the first.
Once the pairs that are left are counted to be few, the last rounds, which
would each be several jobs over next to nothing, are run in arrays of one task.

Vertices are 64-bit hashes of their names; names whose hashes meet get ids of
their own (``NodeIds``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.naming import free_names
from edgewise.model import named
from edgewise.store import drop, write_table

#: Pairs (16 bytes each) that one task labels, if they are counted to be no more.
LOCAL_PAIRS = 500_000
#: Names with an id of their own that are broadcast, if they are counted to be no more.
BROADCAST_NAMES = 100_000


def name_hash(name: Column, bits: int = 63) -> Column:
    """A whole number of at most ``bits`` bits, never negative."""
    return F.xxhash64(name).bitwiseAND(F.lit((1 << bits) - 1))


class NodeIds:
    """64-bit ids of names, different for different names.

    The id of a name is its hash, which is an expression and needs no join.
    Names that share their hash with another (about n²/2⁶⁴ of n names) get
    negative ids instead, by their place among those few names, which no hash
    can meet; so there is no number of names at which ids run out. Only where
    there are such names are they looked up."""

    def __init__(self, own: DataFrame | None = None, few: bool = True, bits: int = 63) -> None:
        self.own, self.few, self.bits = own, few, bits

    @classmethod
    def of(cls, names: DataFrame, column: str = "node", bits: int = 63) -> NodeIds:
        """Checks all of ``names`` (distinct)."""
        hashed = names.select(F.col(column).alias("name"), name_hash(F.col(column), bits).alias("hash"))
        shared = hashed.groupBy("hash").count().filter("count > 1").select("hash")
        return cls(bits=bits) if shared.isEmpty() else cls.renaming(hashed.join(shared, "hash", "left_semi"), bits)

    @classmethod
    def renaming(cls, clashing: DataFrame, bits: int = 63) -> NodeIds:
        """``clashing`` (name): all names that share their hash with others."""
        own = write_table(number_rows(clashing.select("name"), [], "name", "place").select("name", (-F.col("place")).alias("own")), "own-ids")
        return cls(own, own.count() <= BROADCAST_NAMES, bits)

    def expression(self, name: str) -> Column | None:
        """The id of a column, never null, as an expression over it; None if some names must be looked up."""
        return name_hash(F.col(name), self.bits) if self.own is None else None

    def add(self, df: DataFrame, **columns: str) -> DataFrame:
        """``df`` with the ids of its columns: ``add(df, a="f")`` adds ``a``, the id of ``f``."""
        for name, of in columns.items():
            hashed = F.when(F.col(of).isNotNull(), name_hash(F.col(of), self.bits))
            if self.own is None:
                df = df.withColumn(name, hashed)
                continue
            own = self.own.select(F.col("name").alias("_own_name"), F.col("own").alias("_own_id"))
            df = df.join(F.broadcast(own) if self.few else own, F.col(of) == F.col("_own_name"), "left").withColumn(name, F.coalesce("_own_id", hashed)).drop("_own_name", "_own_id")
        return df


def _parents(pairs: DataFrame) -> DataFrame:
    """``(node, parent)`` of the vertices that have a smaller neighbour."""
    return pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))


def _contract(pairs: DataFrame) -> DataFrame:
    """Pairs of the parents. The larger end always has one; a vertex without
    an entry is its own. All three uses of the parents read one shuffle."""
    p = _parents(pairs).select(F.col("node").alias("b"), F.col("parent").alias("pb"))
    q = _parents(pairs).select(F.col("node").alias("a"), F.col("parent").alias("up"))
    moved = pairs.join(p, "b").select("a", "pb").join(q, "a", "left").select(F.coalesce("up", "a").alias("pa"), "pb").filter("pa <> pb")
    return moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()


def _label_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimum propagation with pointer jumping over all pairs of a task."""
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not held:
        return
    ids, codes = np.unique(np.concatenate([x for pair in zip(*held) for x in pair]), return_inverse=True)
    a, b = np.split(codes, 2)
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        following = label.copy()
        # The smaller label goes to both ends and to what they point at.
        for at in (a, b, label[a], label[b]):
            np.minimum.at(following, at, least)
        following = following[following]
        if np.array_equal(following, label):
            break
        label = following
    yield from pa.table({"node": ids, "root": ids[label]}).to_batches()


class Labels:
    """The roots of vertices: tables of ``(node, root)``, of which the first
    that has a vertex counts; a vertex that is in none is its own root."""

    def __init__(self, frames: list[DataFrame], written: list[DataFrame]) -> None:
        self.frames, self.written = frames, written

    def add(self, df: DataFrame, **columns: str | Column) -> DataFrame:
        """``df`` with the roots of its columns: ``add(df, root="id")`` adds
        ``root``, that of ``id``. ``df`` is shuffled once for each. The id may be
        an expression over ``df``, which then isn't shuffled with the rows."""
        for name, of in columns.items():
            vertex, own = named(of), []
            for k, frame in enumerate(self.frames):
                df = df.join(frame.select(F.col("node").alias(f"_at{k}"), F.col("root").alias(f"_root{k}")), vertex == F.col(f"_at{k}"), "left")
                own += [f"_at{k}", f"_root{k}"]
            df = df.withColumn(name, F.coalesce(*own[1::2], vertex)).drop(*own)
        return df

    def root_of(self, vertex: int) -> int:
        """The root of one vertex. Tables that both have it agree, so the last, which is a plain table, is read first."""
        found = (frame.filter(F.col("node") == vertex).select("root").first() for frame in reversed(self.frames))
        return next((row["root"] for row in found if row), vertex)

    def drop(self) -> None:
        """Deletes the tables that the labels are read from."""
        drop(*self.written)


def propagate_minimum(pairs: DataFrame, max_rounds: int = 200, local_pairs: int = LOCAL_PAIRS) -> Labels:
    """The labels of ``pairs`` (a written table; 64-bit ids ``a`` <= ``b``,
    pairs of one vertex mean nothing): all vertices of a component have the
    same root, which is one of them. ``pairs`` must be there until the labels
    have been used.

    A round groups the pairs by their larger end only: the least of the
    smaller ends is that vertex' parent, and vertices without a smaller
    neighbour keep themselves, so they are in no table."""
    levels, labels = [pairs.select("a", "b").filter("a <> b")], None
    for _ in range(max_rounds):
        if local_pairs > 0 and levels[-1].limit(local_pairs + 1).count() <= local_pairs:
            labels = write_table(levels[-1].repartition(1).mapInArrow(_label_arrays, "node bigint, root bigint"), "local-labels")
            drop(levels.pop())
            break
        levels.append(write_table(_contract(levels[-1]), "contracted"))
        if local_pairs <= 0 and levels[-1].isEmpty():
            drop(levels.pop())
            last = levels.pop()
            labels = write_table(_parents(last).withColumnRenamed("parent", "root"), "labels")
            drop(last)
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not levels:
        return Labels([labels], [labels])

    def composed(level: DataFrame, upper: DataFrame) -> DataFrame:
        # A parent has a label only if a later round gave it one.
        placed = _parents(level).join(upper.select(F.col("node").alias("parent"), "root"), "parent", "left")
        return placed.select("node", F.coalesce("root", "parent").alias("root"))

    for level in reversed(levels[1:]):
        # So may vertices that had no parent in this round; where both have a label they agree.
        settled = write_table(composed(level, labels).unionAll(labels).groupBy("node").agg(F.min("root").alias("root")), "labels")
        drop(level, labels)
        labels = settled
    return Labels([composed(levels[0], labels), labels], [labels])


def scoped(name: Column, keys: Sequence[Column]) -> Column:
    """A name within all graphs: the keys' texts with their lengths before it,
    so that no two combinations read alike. Null if the name is."""
    texts = [k.cast("string") for k in keys]
    return F.concat(*(F.coalesce(F.concat(F.length(k), F.lit(":"), k), F.lit("-")) for k in texts), F.lit("|"), name) if keys else name


def component_numbers(ends: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[NodeIds, DataFrame]:
    """``ends``: (keys..., f, t, order...), where ``f`` and ``t`` name vertices
    (of all graphs) and may be null, and ``name_f``, ``name_t`` are their
    names. Gives the vertices' ids and ``(id, group)``. Groups are numbered
    from 1 within ``keys``: by the first row in ``order``, ``f`` before ``t``,
    that names a vertex of the group or, without an order, by the group's
    smallest name."""
    complete = F.col("f").isNotNull() & F.col("t").isNotNull()
    end = lambda slot, c: F.struct(F.lit(slot).alias("slot"), F.col(c).alias("vertex"), F.col(f"name_{c}").alias("name"))
    rows = ends.select(*keys, *order, complete.alias("complete"), F.explode(F.array(end(0, "f"), end(1, "t"))).alias("x")).select("*", "x.*").drop("x").filter("vertex is not null")
    # The first appearance. Of one order column the least is kept for each slot, which hash aggregation can do.
    if len(order) == 1:
        places = {f"_p{slot}": F.when(F.col("complete") & (F.col("slot") == slot), F.col(order[0])) for slot in (0, 1)}
        key = F.when(F.col("_p1").isNull() | (F.col("_p0") <= F.col("_p1")), F.struct(F.col("_p0").alias("o"), F.lit(0).alias("s"))).otherwise(F.struct(F.col("_p1").alias("o"), F.lit(1).alias("s")))
    elif order:
        places, key = {"_p": F.when(F.col("complete"), F.struct(*order, "slot"))}, F.col("_p")
    else:
        places, key = {}, F.col("_p")
    named = rows.groupBy(*keys, "vertex", *([] if order else ["name"])).agg(F.max("complete").alias("complete"), *(F.min(c).alias(a) for a, c in places.items()))
    if not order:
        places, named = {"_p": F.col("_p")}, named.withColumnRenamed("name", "_p")
    nodes = write_table(named, "nodes")
    ids = NodeIds.of(nodes, "vertex")
    pairs = write_table(ids.add(ends.filter("f is not null and t is not null and f <> t").select("f", "t"), a="f", b="t").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs")
    labels = propagate_minimum(pairs)
    rooted = write_table(labels.add(ids.add(nodes.filter("complete"), id="vertex"), root="id").select(*keys, "id", "root", *places), "rooted")
    drop(pairs, nodes)
    labels.drop()
    roots = rooted.groupBy(*keys, "root").agg(*(F.min(a).alias(a) for a in places)).withColumn("key", key)
    numbered = number_rows(roots.select(*keys, "root", "key"), keys, "key", "group")
    return ids, rooted.select("id", "root").join(numbered.select("root", "group"), "root").select("id", "group")


def number_rows(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... in the order of ``order``, within ``keys`` if
    there are any. The rows are range-partitioned by keys and order, numbered
    within each partition, and shifted by the rows of their key in the
    partitions before it; no task sees more than its own range, also where
    one key has most rows."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = write_table(df.repartitionByRange(int(parts), *keys, order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A partition has at most one key that began before it, so this is at most a row for each partition.
    before = sizes.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0").select(F.col("_part").alias("_at"), *(F.col(k).alias(f"_at_{i}") for i, k in enumerate(keys)), "_before")
    local = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(order)))
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{i}"))
    shifted = local.join(F.broadcast(before), same, "left")
    return shifted.select(*df.columns, (F.coalesce("_before", F.lit(0)) + F.col("_row")).cast("bigint").alias(name))


def super_merger(
    df: DataFrame, from_col_name: str | Column, to_col_name: str | Column, order_by: str | Column | Sequence[str | Column] | None = None, partition_by: Sequence[str | Column] = ()
) -> DataFrame:
    """All columns of ``df`` and ``group``: the number of the connected
    component of the row's ``from`` node.

    Ends, order and keys are column names or expressions over ``df``. ``from``
    and ``to`` are compared as strings. A row with a null end links nothing;
    its ``group`` is that of its ``from`` node if another, complete row names
    that node, else 0. A row that names one node twice makes that node a
    group. Repeated rows are kept and get the same number. An existing column
    ``group`` (in any case) is replaced; all other columns are untouched,
    whatever their names. An empty table gives an empty table.

    Groups are numbered 1, 2, 3 ... by first appearance in the order of
    ``order_by``, or by the smallest node name where that isn't given; rows
    that tie in ``order_by`` count as one place, so it should be unique. With
    ``partition_by``, each combination of those values is a graph of its own."""
    order = [order_by] if isinstance(order_by, (str, Column)) else list(order_by or ())
    ks = [f"_k{i}" for i in range(len(partition_by))]
    os = [f"_o{i}" for i in range(len(order))]
    vertex = lambda name: scoped(F.col(name), [F.col(k) for k in ks])
    inputs = [*(named(k).alias(a) for k, a in zip(partition_by, ks)), named(from_col_name).cast("string").alias("name_f")]
    ends = df.select(*inputs, named(to_col_name).cast("string").alias("name_t"), *(named(c).alias(a) for c, a in zip(order, os))).withColumn("f", vertex("name_f")).withColumn("t", vertex("name_t"))
    ids, groups = component_numbers(ends, ks, os)
    # The row's vertex and its id travel with the row under names that can't clash.
    start, key, at, group = free_names(df.columns, "start", "id", "at", "number")
    keyed = ids.add(df.withColumn(start, scoped(named(from_col_name).cast("string"), [named(k) for k in partition_by])), **{key: start})
    joined = keyed.join(groups.select(F.col("id").alias(at), F.col("group").alias(group)), F.col(key) == F.col(at), "left")
    kept = [c for c in df.columns if c.lower() != "group"]
    return joined.select(*(named(c) for c in kept), F.coalesce(F.col(group), F.lit(0)).cast("bigint").alias("group"))


def graph_solver(
    df: DataFrame, expr_from: str | Column, expr_to: str | Column, order_by: str | Column | Sequence[str | Column] | None = None, partition_by: Sequence[str | Column] = ()
) -> DataFrame:
    """Row-aligned component numbers; the same as ``super_merger``, under the
    name of the expression form."""
    return super_merger(df, expr_from, expr_to, order_by, partition_by)


def super_merger_weighted(
    df: DataFrame,
    from_col_name: str | Column,
    to_col_name: str | Column,
    weighted_col_name: str | Column,
    weight_threshold: float = 0.1,
    order_by: str | Column | Sequence[str | Column] | None = None,
    partition_by: Sequence[str | Column] = (),
) -> DataFrame:
    """``super_merger`` over the rows whose weight is at least
    ``weight_threshold``; other rows, and rows without a weight, are not part
    of the result. NaN counts as larger than any number. Groups are numbered
    after the filter."""
    strong = df.filter(named(weighted_col_name).try_cast("double") >= F.lit(float(weight_threshold)))
    return super_merger(strong, from_col_name, to_col_name, order_by, partition_by)
