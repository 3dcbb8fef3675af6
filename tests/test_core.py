import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from edgewise.functions import clean_source, clean_value
from edgewise.functions.naming import free_names
from edgewise.operators.components import number_rows
from edgewise.operators.key_counts import counts_per_key, hot_keys
from edgewise.plans.oracles import ORACLES
from edgewise.plans.queries import QUERIES, entry
from edgewise.store import drop, path_of, shared_dir, working_tables, write_table


def test_clean_values(spark):
    rows = [(x,) for x in (" a\t", "\nB", "", "  ", " n/a ", None, "a b")]
    out = spark.createDataFrame(rows, "x string").select(clean_value("x").alias("v"), clean_source("x").alias("s")).collect()
    assert [r["v"] for r in out] == ["A", "B", None, None, None, None, "A B"]
    assert [r["s"] for r in out] == ["a", "b", None, None, "n/a", None, "a b"]


def test_free_names():
    assert free_names(["Node", "_node", "x"], "node", "group") == ["__node", "group"]


def test_number_rows(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int")
    assert sorted((r["x"], r["n"]) for r in number_rows(df, [], "x", "n").collect()) == [(i, i + 1) for i in range(101)]


def test_written_tables(spark):
    table = write_table(spark.range(5).withColumnRenamed("id", "x"), "t")
    assert path_of(table).startswith(shared_dir(spark))
    assert table.count() == 5
    drop(table, None, spark.range(1))
    with pytest.raises(Exception):
        table.count()


def test_working_tables_go(spark):
    with working_tables(spark):
        table = write_table(spark.range(5), "t")
        assert table.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path_of(table))


def test_number_rows_within_a_hot_key(spark):
    rows = [("hot" if i % 10 else None if i % 20 else "k", i * 7 % 1009) for i in range(1000)]
    found = number_rows(spark.createDataFrame(rows, "k string, x int"), ["k"], "x", "n").collect()
    expected = {(k, x): n for key in {k for k, _ in rows} for n, (k, x) in enumerate(sorted(r for r in rows if r[0] == key), 1)}
    assert {(r["k"], r["x"]): r["n"] for r in found} == expected


@pytest.mark.parametrize("split_keys", [5, 1_000_000])
def test_counts_per_key(spark, split_keys):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + [None] + [f"k{i}" for i in range(40)]), rng.choice(["hot", None, "z"])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(7).withColumn("key", F.lit(1))
    found = {r["key"]: (r["x"], r["y"]) for r in counts_per_key(df, [F.col("a"), F.col("b")], ["x", "y"], split_keys=split_keys).collect()}
    a, b = Counter(r[0] for r in rows), Counter(r[1] for r in rows)
    assert found == {k: (a[k], b[k]) for k in (set(a) | set(b)) - {None}}


def test_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "a string, b string")
    counts = counts_per_key(empty, [F.col("a"), F.col("b")], ["x", "y"])
    assert counts.count() == 0
    assert hot_keys(counts, "key", ["x", "y"], 1 / 50).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "a string, b string")
    assert counts_per_key(nulls, [F.col("a")], ["x"]).count() == 0


def test_hot_keys(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] * 98, "k string")
    counts = counts_per_key(df, [F.col("k")], ["x"])
    assert {(r["key"], r["n"], r["total"]) for r in hot_keys(counts, "key", ["x"], 1 / 50).collect()} == {("a", 2, 100), ("b", 98, 100)}
    assert hot_keys(counts, "key", ["x"], 1 / 40).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_against_sql(against_sql, name):
    against_sql(QUERIES[name], ORACLES[name])


def test_entry(spark):
    assert entry(spark, "/root/testdata/sf0.001").count() > 0


def test_nothing_in_the_core_needs_llm():
    code = """
import sys, importlib, pkgutil
sys.modules['edgewise.llm'] = None
import edgewise
for m in pkgutil.walk_packages(edgewise.__path__, 'edgewise.'):
    if not m.name.startswith('edgewise.llm'):
        importlib.import_module(m.name)
import __spark_entry__ as e
assert set(e.queries()) == set(e.oracle_sql())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
