"""Graphs whose edges are counted to be few, in arrays.

A fixpoint loop over tables is several jobs a round, which is what a large
graph needs and far more than a small one does. A task can hold the whole edge
list of a small one: up to ``RANKED_EDGES`` merged edges (about 100 MB)
PageRank runs in one task; up to ``LOCAL_EDGES`` the kernels that start from
every node (shortest paths, betweenness) run in several tasks, each of which
gets all edges and its share of the start nodes, and gives out its results as
it goes. Nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Merged edges that each of many tasks holds, and that one task holds.
LOCAL_EDGES, RANKED_EDGES = 200_000, 1_000_000
#: Pairs of nodes that shortest paths in arrays may have to give out.
LOCAL_PAIRS = 50_000_000
#: Cells of the work arrays (start nodes times edges) at a time, and of a task at least; rows of edges that all tasks get together.
CELLS, SENT_EDGES = 2_000_000, 10_000_000
UNREACHED = np.int64(2**62)


def _codes(src: pa.ChunkedArray, dst: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes in order of bytes, and both ends as their places."""
    ends = pa.concat_arrays([*src.cast(pa.string()).chunks, *dst.cast(pa.string()).chunks]).dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[ends.indices.to_numpy()]
    return ends.dictionary.take(pa.array(order)), codes[: len(src)], codes[len(src) :]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys: where each run begins, and its key."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return first, keys[first]


def page_rank_arrays(d: float, max_iterations: int, threshold: float, redistribute: bool, scoped: bool):
    """(src, dst, mult) of all edges to (node, score, iterations). If
    ``scoped``, what a name has before its first ``|`` is its graph; each graph
    has its own size and ends when its own scores have converged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        names, src, dst = _codes(table["src"], table["dst"])
        graph = pc.split_pattern(names, "|", max_splits=1) if scoped else None
        graph = pc.list_element(graph, 0).dictionary_encode().indices.to_numpy() if scoped else np.zeros(len(names), np.int64)
        mult = table["mult"].to_numpy().astype(float)
        n = np.bincount(graph)
        base, degree = ((1.0 - d) / n)[graph], np.bincount(src, mult, len(names))
        score, done, active = (1.0 / n)[graph], np.zeros(len(n), np.int32), np.ones(len(n), bool)
        for _ in range(max_iterations):
            flow = np.bincount(dst, score[src] / degree[src] * mult, len(names))
            lost = (d * np.bincount(graph, np.where(degree == 0, score, 0.0)) / n)[graph] if redistribute else 0.0
            following = np.where(active[graph], base + lost + d * flow, score)
            change, score = np.bincount(graph, np.abs(following - score)), following
            done += active
            active &= change >= threshold
            if not active.any():
                break
        yield from pa.table({"node": names, "score": score, "iterations": pa.array(done[graph], pa.int32())}).to_batches(max_chunksize=65_536)

    return run


def from_every_node(edges: DataFrame, rows: int, nodes: int, kernel: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], columns: list[str], schema: str) -> DataFrame:
    """Runs ``kernel`` (all edges, a task's start nodes as places) in as many
    tasks as the session has cores, or fewer: each has ``CELLS`` cells of work
    at least, and all together get ``SENT_EDGES`` rows at most."""
    tasks = max(1, min(edges.sparkSession.sparkContext.defaultParallelism, nodes * rows // CELLS, SENT_EDGES // max(1, rows)))
    spread = edges.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, own, held = None, set(), []
        for batch in batches:  # the edges are the same for each of the partition's tasks
            own.update(batch["task"].unique().to_pylist())
            first = min(own) if first is None else first
            held.append(batch.filter(pc.equal(batch["task"], first)))
        if own:
            starts = np.sort(np.concatenate([np.arange(task, nodes, tasks) for task in own]))
            for table in kernel(pa.Table.from_batches(held), starts):
                yield from table.to_batches(max_chunksize=65_536)

    return spread.repartition(tasks, "task").mapInArrow(run, schema)


def shortest_paths(directed: bool):
    def kernel(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        names, src, dst = _codes(table["src"], table["dst"])
        order = np.argsort(dst, kind="stable")
        src, w = src[order], table["w"].to_numpy()[order]
        first, ends = _runs(dst[order])
        for at in range(0, len(starts), step := max(1, CELLS // max(len(src), len(names)))):
            own = starts[at : at + step]
            cost = np.full((len(own), len(names)), UNREACHED)
            cost[np.arange(len(own)), own] = 0
            while True:
                best = np.minimum(np.minimum.reduceat(cost[:, src] + w, first, axis=1), cost[:, ends])
                if np.array_equal(best, cost[:, ends]):
                    break
                cost[:, ends] = best
            i, j = np.nonzero(cost < UNREACHED)
            keep = own[i] != j if directed else own[i] < j
            yield pa.table({"src": names.take(pa.array(own[i][keep])), "dst": names.take(pa.array(j[keep])), "cost": cost[i, j][keep]})

    return kernel


def dependencies(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
    """Sums of the start nodes' path dependencies on each node."""
    names, src, dst = _codes(table["src"], table["dst"])
    mult = table["mult"].to_numpy().astype(float)
    into, out = np.argsort(dst, kind="stable"), np.argsort(src, kind="stable")
    first_in, ends = _runs(dst[into])
    first_out, begins = _runs(src[out])
    total = np.zeros(len(names))
    for at in range(0, len(starts), step := max(1, CELLS // max(len(src), len(names)))):
        own = starts[at : at + step]
        rows = np.arange(len(own))
        depth, paths = np.full((len(own), len(names)), -1), np.zeros((len(own), len(names)))
        depth[rows, own], paths[rows, own], level = 0, 1.0, 0
        while True:
            arriving = np.add.reduceat(np.where(depth[:, src[into]] == level, paths[:, src[into]], 0.0) * mult[into], first_in, axis=1)
            fresh = (depth[:, ends] < 0) & (arriving > 0)
            if not fresh.any():
                break
            level += 1
            depth[:, ends] = np.where(fresh, level, depth[:, ends])
            paths[:, ends] = np.where(fresh, arriving, paths[:, ends])
        delta = np.zeros_like(paths)
        s, t, m = src[out], dst[out], mult[out]
        for back in range(level - 1, -1, -1):
            on = (depth[:, s] == back) & (depth[:, t] == back + 1)
            flow = np.where(on, m * paths[:, s] / np.where(on, paths[:, t], 1.0) * (1.0 + delta[:, t]), 0.0)
            delta[:, begins] += np.add.reduceat(flow, first_out, axis=1)
        delta[rows, own] = 0.0
        total += delta.sum(axis=0)
    yield pa.table({"node": names, "part": total})
