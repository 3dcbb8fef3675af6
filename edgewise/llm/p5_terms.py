"""Frequency of every distinct value or term, kept up to date by signed deltas.

The counts are a store in the shared folder, of three tables that grow by runs:

* ``pairs`` (term, record, n): how often a record has a term,
* ``terms`` (term, n_rows, n_records): the result,
* ``records`` (record, n): how many terms' rows a record has.

A change is a set of signed rows (+1 added, -1 deleted; a changed record is its
old rows at -1 and its new rows at +1). Only these are aggregated: to signed
changes of (term, record). The counts so far of just these pairs are looked up
in ``pairs``; where a pair's count leaves or reaches zero, the term's record
count changes by one. The signed changes of each table are written as one more
run, so a change writes about as much as it brings. A table is the sum of its
runs; its runs are merged once those that came after the largest have half its
rows, or are many, so that a row is rewritten a few times in all. A manifest,
written last, names the valid runs: a failed change leaves the previous state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions import clean_value
from edgewise.model import named
from edgewise.store import append_table, delete, drop, hadoop_path, new_path, write_table

SCHEMAS = {
    "pairs": "term string, record bigint, n bigint",
    "terms": "term string, n_rows bigint, n_records bigint",
    "records": "record bigint, n bigint",
}
KEYS = {"pairs": ["term", "record"], "terms": ["term"], "records": ["record"]}
SUMS = {"pairs": ["n"], "terms": ["n_rows", "n_records"], "records": ["n"]}
#: Keys of a change that are broadcast, if they are counted to be no more.
BROADCAST_KEYS = 500_000
#: Runs of a table that are merged: as many, or when the later ones have this share of the largest one's rows.
MAX_RUNS, MERGE_SHARE = 16, 0.5


class TermCounts:
    """Persistent counts of terms and of the records that have them."""

    def __init__(self, spark: SparkSession, path: str | None = None, broadcast_keys: int = BROADCAST_KEYS) -> None:
        """``path``: the store's folder, by default a new one in the session's
        folder. One writer at a time. ``broadcast_keys``: the largest number
        of changed keys (counted) that is broadcast to look up their counts."""
        self.spark, self.path, self.broadcast_keys = spark, path or new_path(spark, "term-counts"), broadcast_keys
        state = self._read_manifest()
        self.version: int = state["version"] if state else 0
        self.n_records: int = state["n_records"] if state else 0
        self.runs: dict[str, dict[str, int]] = state["runs"] if state else {name: {} for name in SCHEMAS}

    def _names(self, folder: str) -> list[str]:
        p, fs = hadoop_path(self.spark, folder)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _manifests(self) -> list[int]:
        """Versions whose manifest was written to its end."""
        names = [n for n in self._names(self.path) if n.startswith("manifest-")]
        return sorted(int(n.rpartition("-")[2]) for n in names if "_SUCCESS" in self._names(f"{self.path}/{n}"))

    def _read_manifest(self) -> dict | None:
        versions = self._manifests()
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{versions[-1]}").first()["value"]) if versions else None

    def _write_manifest(self) -> None:
        old = self._manifests()
        text = json.dumps({"version": self.version, "n_records": self.n_records, "runs": self.runs})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.version}")
        for version in old:
            delete(self.spark, f"{self.path}/manifest-{version}")
        self._clear()

    def _clear(self) -> None:
        """Deletes runs that no manifest names: merged ones, and those of a change that failed."""
        for name in SCHEMAS:
            for run in self._names(f"{self.path}/{name}"):
                if run not in self.runs[name]:
                    delete(self.spark, f"{self.path}/{name}/{run}")

    def _read(self, name: str) -> DataFrame:
        """The rows of all runs."""
        paths = [f"{self.path}/{name}/{run}" for run in self.runs[name]]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def table(self, name: str) -> DataFrame:
        """A table of the store: sums over its runs, without keys whose first sum is zero."""
        rows = self._read(name)
        if len(self.runs[name]) > 1:
            rows = rows.groupBy(*KEYS[name]).agg(*(F.sum(c).alias(c) for c in SUMS[name]))
        return rows.filter(f"{SUMS[name][0]} > 0")

    def _add_run(self, name: str, rows: DataFrame) -> DataFrame:
        run = f"run-{self.version}-{uuid.uuid4().hex}"
        table = append_table(rows, f"{self.path}/{name}/{run}")
        self.runs[name][run] = table.count()
        return table

    def _merge_runs(self) -> None:
        for name, runs in self.runs.items():
            largest = max(runs.values(), default=0)
            if len(runs) > MAX_RUNS or sum(runs.values()) - largest > MERGE_SHARE * largest:
                merged = self.table(name)
                self.runs[name] = {}
                self._add_run(name, merged)

    def _had(self, name: str, delta: DataFrame, size: int) -> DataFrame:
        """``delta`` with ``had``: the sum so far of each of its keys."""
        if not self.runs[name]:
            return delta.withColumn("had", F.lit(0).cast("bigint"))
        few = lambda keys: F.broadcast(keys) if size <= self.broadcast_keys else keys
        keys = delta.select(*(F.col(k).alias(f"_{k}") for k in KEYS[name]))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS[name]]
        touched = self._read(name).join(few(keys), same, "left_semi")
        # Sums so far and changes meet in one group; of the store only rows of changed keys are there.
        met = touched.select(*KEYS[name], F.lit(0).cast("bigint").alias("n"), F.col("n").alias("had")).unionByName(delta.select(*KEYS[name], "n", F.lit(0).cast("bigint").alias("had")))
        return met.groupBy(*KEYS[name]).agg(F.sum("n").alias("n"), F.sum("had").alias("had"))

    def apply(self, changes: DataFrame) -> TermCounts:
        """``changes``: (term, record, sign). Rows without a term count
        nowhere; rows without a record count as rows of their term and belong
        to no record. A pair's count never falls below zero: deletions of what
        isn't there change nothing. Returns the store."""
        self._clear()
        self.version += 1
        signed = changes.filter("term is not null").groupBy("term", "record").agg(F.sum("sign").cast("bigint").alias("n")).filter("n <> 0")
        became = (F.col("had") + F.col("n") > 0).cast("bigint") - (F.col("had") > 0).cast("bigint")
        bounded = F.greatest("n", -F.col("had"))
        if self.runs["pairs"]:
            delta = write_table(signed, "term-delta")
            moves = self._had("pairs", delta, delta.count())
        else:  # a first load has nothing to look up
            delta, moves = None, signed.withColumn("had", F.lit(0).cast("bigint"))
        moves = moves.select("term", "record", bounded.alias("n"), F.when(F.col("record").isNotNull(), became).otherwise(0).alias("d_records")).filter("n <> 0")
        moves = write_table(moves, "term-moves") if delta is not None else moves
        if delta is None:
            pairs = self._add_run("pairs", moves.select("term", "record", "n"))
            moves = pairs.withColumn("d_records", F.col("record").isNotNull().cast("bigint"))
        else:
            self._add_run("pairs", moves.select("term", "record", "n"))
        self._add_run("terms", moves.groupBy("term").agg(F.sum("n").alias("n_rows"), F.sum("d_records").alias("n_records")))
        of_records = moves.filter("record is not null").groupBy("record").agg(F.sum("n").alias("n"))
        if self.runs["records"]:
            of_records = write_table(of_records, "record-delta")
            self.n_records += self._had("records", of_records, of_records.count()).agg(F.coalesce(F.sum(became), F.lit(0)).alias("d")).first()["d"]
            self._add_run("records", of_records)
            drop(of_records)
        else:
            self._add_run("records", of_records)
            self.n_records = next(iter(self.runs["records"].values()))
        self._merge_runs()
        self._write_manifest()
        drop(delta, moves)
        return self

    def marks(self, rare_below: int = 3, common_share: int = 20) -> DataFrame:
        """``(term, n_rows, n_records, mark)``: ``rare`` for terms in fewer
        than ``rare_below`` records, ``common`` for terms in more than
        1/``common_share`` of all records, else null."""
        mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") * common_share > F.lit(self.n_records), "common")
        return self.table("terms").select("term", "n_rows", "n_records", mark.alias("mark"))


def signed_rows(transactions: DataFrame, sign: int = 1, item_col: str | Column = "item_id", record_col: str | Column = "transaction_id") -> DataFrame:
    """Rows of ``transactions`` as changes: the clean item as the term."""
    return transactions.select(clean_value(named(item_col)).alias("term"), named(record_col).try_cast("bigint").alias("record"), F.lit(sign).alias("sign"))


def term_frequencies(*changes: DataFrame) -> TermCounts:
    """A new store with all rows of ``changes``, each frame a change of its own.

    Every row counts, repeated and late ones too; an item that a record has
    several times counts once for its records. Missing items (null, empty,
    ``N/A``) count nowhere; a row without a record counts as a row only. An
    empty table gives an empty store."""
    store = TermCounts(changes[0].sparkSession)
    for rows in changes:
        store.apply(signed_rows(rows))
    return store
