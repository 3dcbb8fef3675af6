"""Connected components of a stream of edges.

``RunningGroups.update`` is a function for ``foreachBatch``. The state is a
folder of two tables: ``nodes`` gives each node the key that it first got, and
is only added to, by the new nodes of a batch; ``moves`` tells which keys have
since become part of another group, and is the only thing written anew. A
batch counts once the success mark of its ``moves`` is there, which is written
last: a batch that failed or is delivered again changes nothing, and a new
object over the same folder goes on where the last one ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.model import edge_rows
from edgewise.operators.components import NodeIds, propagate_minimum
from edgewise.store import delete, drop, hadoop_path, new_path, write_table


class RunningGroups:
    """``labels``: (node, group_key), with the smallest node of each group."""

    def __init__(self, spark: SparkSession, from_col: str | Column = "from", to_col: str | Column = "to", path: str | None = None) -> None:
        """``path``: the state's folder, by default a new one in the session's."""
        self.spark, self.from_col, self.to_col = spark, from_col, to_col
        self.path = path or new_path(spark, "running-groups")
        self.last_batch = max(self._batches("moves"), default=-1)

    def _batches(self, table: str) -> list[int]:
        p, fs = hadoop_path(self.spark, f"{self.path}/{table}")
        if not fs.exists(p):
            return []
        found = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n.removeprefix("batch-")) for n in found if fs.exists(hadoop_path(self.spark, f"{self.path}/{table}/{n}/_SUCCESS")[0]))

    def _read(self, table: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/{table}/batch-{b}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def _nodes(self) -> DataFrame:
        return self._read("nodes", "node string, key string", [b for b in self._batches("nodes") if b <= self.last_batch])

    @property
    def _moves(self) -> DataFrame:
        return self._read("moves", "key string, group_key string", [self.last_batch] if self.last_batch >= 0 else [])

    @property
    def labels(self) -> DataFrame:
        return self._nodes.join(self._moves, "key", "left").select("node", F.coalesce("group_key", "key").alias("group_key"))

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Adds the edges of a micro-batch. Rows with a null end take no part."""
        if batch_id <= self.last_batch:
            return
        edges = write_table(edge_rows(batch, self.from_col, self.to_col).distinct(), "batch-edges")
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        # Each node of the batch with its group so far, or itself.
        met = nodes.join(self.labels, "node", "left")
        known = write_table(met.select("node", F.coalesce("group_key", "node").alias("group"), F.col("group_key").isNull().alias("new")), "batch-nodes")
        groups = write_table(known.select(F.col("group").alias("node")).distinct(), "batch-groups")
        ids = NodeIds.of(groups)
        at = lambda end, name: known.select(F.col("node").alias(end), F.col("group").alias(name))
        linked = ids.add(edges.join(at("src", "f"), "src").join(at("dst", "t"), "dst"), a="f", b="t")
        pairs = write_table(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "batch-pairs")
        roots = propagate_minimum(pairs)
        placed = write_table(roots.add(ids.add(groups, id="node"), root="id").select(F.col("node").alias("key"), "root"), "batch-placed")
        merged = placed.join(placed.groupBy("root").agg(F.min("key").alias("group_key")), "root").filter("key <> group_key").select("key", "group_key")
        merged = write_table(merged, "batch-merged")
        known.filter("new").select("node", F.col("node").alias("key")).write.mode("overwrite").parquet(f"{self.path}/nodes/batch-{batch_id}")
        # Keys that moved before follow the group they are in.
        further = merged.select(F.col("key").alias("group_key"), F.col("group_key").alias("on"))
        moved = self._moves.join(further, "group_key", "left").select("key", F.coalesce("on", "group_key").alias("group_key"))
        moved.unionByName(merged).write.mode("overwrite").parquet(f"{self.path}/moves/batch-{batch_id}")
        old = [b for b in self._batches("moves") if b < batch_id]
        self.last_batch = batch_id
        for b in old:
            delete(self.spark, f"{self.path}/moves/batch-{b}")
        drop(edges, known, groups, pairs, placed, merged)
        roots.drop()
