"""Groups, frequent items, top entries, term counts and pairs."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from edgewise.llm.oracles import ORACLES
from edgewise.llm.p1_groups import match_groups
from edgewise.llm.p2_frequent import frequent_items
from edgewise.llm.p4_topn import top_entries
from edgewise.llm.p5_terms import TermCounts, signed_rows, term_frequencies
from edgewise.llm.p6_pairs import pairs_together
from edgewise.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(against_sql, name):
    against_sql(QUERIES[name], ORACLES[name])


def _groups(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        if a and b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(("tail", "broadcast_ids"), [(0.0, 500_000), (0.01, 500_000), (0.5, 0)])
def test_groups(spark, tail, broadcast_ids):
    rng = random.Random(tail)
    rows = [("HUB", f"H{i}") for i in range(150)] + [(f"H{rng.randrange(150)}", f"J{rng.randrange(80)}") for _ in range(100)]
    rows += [(f"C{i}", f"C{i + 1}") for i in range(70)] + [("J3", "ARM0")] + [(f"ARM{i}", f"ARM{i + 1}") for i in range(9)]
    rows += [(f"S{i}", f"T{i}") for i in range(50)] + [("SELF", "SELF")] + rows[:30] + [(b, a) for a, b in rows[:30]]
    df = spark.createDataFrame(rows, "`from` string, `to` string").repartition(5).withColumn("node", F.lit(1)).withColumn("a", F.lit("x"))
    found = {r["node"]: r["group_key"] for r in match_groups(df, tail=tail, broadcast_ids=broadcast_ids).collect()}
    assert found == _groups(rows)


@pytest.mark.parametrize("local_pairs", [0, 500_000])
def test_groups_when_names_share_their_ids(spark, local_pairs):
    rng = random.Random(8)
    rows = [(f"N{rng.randrange(90)}", f"N{rng.randrange(90)}") for _ in range(60)] + [("N1", f"N{i}") for i in range(5, 30)]
    df = spark.createDataFrame(rows, "`from` string, `to` string")
    found = {r["node"]: r["group_key"] for r in match_groups(df, local_pairs=local_pairs, bits=5).collect()}
    assert found == _groups(rows)


def test_groups_of_dirty_rows(spark):
    rows = [(" a\t", "B"), ("b ", "c"), ("N/A", "Q"), ("", "R"), (None, "S"), ("T", None), (None, None), ("x", " X")]
    df = spark.createDataFrame(rows, "`from` string, `to` string")
    assert {r["node"]: r["group_key"] for r in match_groups(df).collect()} == {"A": "A", "B": "A", "C": "A", "X": "X"}
    assert match_groups(df.limit(0)).collect() == []
    assert match_groups(df.filter("`to` = 'Q'")).collect() == []


def test_frequent_items(spark):
    rng = random.Random(9)
    rows = [(rng.choice([" a", "A", "b", "c", None, "", "n/a"] + [f"r{i}" for i in range(60)]),) for _ in range(4000)]
    df = spark.createDataFrame(rows, "item_id string").repartition(6).withColumn("n", F.lit(0))
    counts = Counter(x.strip().upper() for (x,) in rows if x and x.strip().upper() != "N/A")
    for k in (1, 5, 40, 500):
        expected = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
        found = frequent_items(df, k=k).collect()
        assert sorted(((r["item"], r["n"]) for r in found), key=lambda x: (-x[1], x[0])) == expected
        assert {r["total"] for r in found} == {sum(counts.values())}


def test_frequent_items_of_nothing(spark):
    assert frequent_items(spark.createDataFrame([], "item_id string")).collect() == []
    assert frequent_items(spark.createDataFrame([(None,), ("",)], "item_id string")).collect() == []


def test_frequent_items_spread_evenly(spark):
    """An item that leads nowhere, but is on every node, is found."""
    rows = [(f"lead{p}-{i}", p) for p in range(8) for i in range(3) for _ in range(12)] + [("everywhere", p) for p in range(8) for _ in range(10)]
    df = spark.createDataFrame(rows, "item_id string, p int").repartitionByRange(8, "p")
    assert [r["item"] for r in frequent_items(df, k=1).collect()] == ["EVERYWHERE"]


def test_top_entries(spark):
    nan = float("nan")
    rows = [
        ("a", ["x", "y", "z", None, " X ", "n/a"], [0.5, 0.5, nan, 1.0, 0.9, 1.0]), (" A", ["w", "v"], [0.5]), ("a", None, [1.0]), ("a", [], []), ("b", ["x"], None),
        (None, ["x"], [1.0]), ("c", ["q", "r", "s"], [None, 0.0, -1.0]), ("a", ["y"], [0.5]),
    ]
    df = spark.createDataFrame(rows, "item string, consequents array<string>, confidence_scores array<double>").withColumn("place", F.lit("p")).withColumn("score", F.lit(1))
    found = sorted(tuple(r) for r in top_entries(df, 3).collect())
    assert found == [("A", 1, "X", 0.9), ("A", 2, "W", 0.5), ("A", 3, "Y", 0.5), ("C", 1, "R", 0.0), ("C", 2, "S", -1.0)]
    assert top_entries(df.limit(0)).collect() == []


def test_top_entries_prune_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", ["x"], [1.0])], "item string, consequents array<string>, confidence_scores array<double>")
    plan = top_entries(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def _terms(rows):
    n, records = Counter(), defaultdict(set)
    for b, item in rows:
        if item and item.strip() and item.strip().upper() != "N/A":
            n[item.strip().upper()] += 1
            if b is not None:
                records[item.strip().upper()].add(b)
    return {t: (n[t], len(records[t])) for t in n}


@pytest.mark.parametrize("broadcast_keys", [0, 500_000])
@pytest.mark.parametrize("max_runs", [1, 16])
def test_term_deltas(spark, monkeypatch, broadcast_keys, max_runs):
    from edgewise.llm import p5_terms

    monkeypatch.setattr(p5_terms, "MAX_RUNS", max_runs)
    rng = random.Random(5)
    make = lambda k: [(rng.choice([None, *range(30)]), rng.choice(["hot", " HOT", None, "", "n/a"] + [f"t{i}" for i in range(20)])) for _ in range(k)]
    frame = lambda rows: spark.createDataFrame(rows, "transaction_id bigint, item_id string")
    base, added = make(400), make(60)
    store = TermCounts(spark, broadcast_keys=broadcast_keys).apply(signed_rows(frame(base)))
    found = lambda s: {r["term"]: (r["n_rows"], r["n_records"]) for r in s.table("terms").collect()}
    records = lambda rows: len({b for b, item in rows if b is not None and _terms([(b, item)])})
    assert found(store) == _terms(base)
    assert store.n_records == records(base)
    store.apply(signed_rows(frame(added)))
    assert found(store) == _terms(base + added)
    assert store.n_records == records(base + added)
    gone = base[:150]
    store.apply(signed_rows(frame(gone), -1))
    assert found(store) == _terms(base[150:] + added)
    assert store.n_records == records(base[150:] + added)
    again = TermCounts(spark, path=store.path)  # another session reads the same counts
    assert again.n_records == store.n_records
    assert found(again) == found(store)
    assert all(len(r) <= max_runs for r in again.runs.values())
    # What isn't there can't be deleted, and nothing changes nothing.
    again.apply(signed_rows(frame([(1, "never"), (2, "t1")] * 500), -1))
    again.apply(signed_rows(frame([])))
    left = [r for r in base[150:] + added if not (r[0] == 2 and r[1] == "t1")]
    assert found(again) == _terms(left)
    assert again.n_records == records(left)


def test_a_change_writes_what_it_brings(spark, tmp_path):
    """A change of 6 % leaves the pairs' files as they are and adds a small multiple of itself."""
    frame = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 4001).alias("transaction_id"), F.concat(F.lit("t"), F.col("id") % 977).alias("item_id"))
    size = lambda: {p: p.stat().st_size for p in tmp_path.rglob("*.parquet")}
    store = TermCounts(spark, path=str(tmp_path)).apply(signed_rows(frame(0, 100_000)))
    before = size()
    store.apply(signed_rows(frame(100_000, 106_000)))
    after = size()
    assert {p: n for p, n in before.items() if "pairs" in p.parts}.items() <= after.items()
    assert sum(after.values()) - sum(before.values()) < 0.25 * sum(before.values())
    # A failed change leaves runs that nothing names; the next change removes them.
    spark.range(3).selectExpr("'lost' as term", "id as record", "id as n").write.parquet(str(tmp_path / "pairs" / "run-9-lost"))
    store.apply(signed_rows(frame(0, 10), -1))
    assert not (tmp_path / "pairs" / "run-9-lost").exists()


def test_failed_change_leaves_the_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "transaction_id bigint, item_id string")
    store = TermCounts(spark, path=str(tmp_path)).apply(signed_rows(df))
    bad = df.withColumn("item_id", F.when(F.col("transaction_id") == 2, F.raise_error(F.lit("lost"))).otherwise("c"))
    with pytest.raises(Exception):
        store.apply(signed_rows(bad))
    again = TermCounts(spark, path=str(tmp_path))
    assert {r["term"]: (r["n_rows"], r["n_records"]) for r in again.table("terms").collect()} == {"A": (2, 2), "B": (1, 1)}


def test_term_marks(spark):
    rows = [(b, "common") for b in range(40)] + [(1, "rare"), (2, "rare"), (None, "rare")] + [(b, "middle") for b in range(2)] + [(7, "third"), (8, "third")] + [(9, "third")] + [(None, "lone")]
    df = spark.createDataFrame(rows, "transaction_id bigint, item_id string").withColumn("term", F.lit(1))
    found = {r["term"]: r["mark"] for r in term_frequencies(df).marks().collect()}
    assert found == {"COMMON": "common", "RARE": "rare", "MIDDLE": "rare", "THIRD": "common", "LONE": "rare"}
    assert term_frequencies(df.limit(0)).marks().collect() == []


def _pairs(rows, min_common, min_lift):
    baskets = defaultdict(set)
    for b, item in rows:
        if b is not None and item:
            baskets[b].add(item.strip().upper())
    n = Counter(i for s in baskets.values() for i in s)
    c = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {(a, b, k) for (a, b), k in c.items() if k >= min_common and k * len(baskets) >= min_lift * n[a] * n[b]}


@pytest.mark.parametrize(("item_block", "record_block", "broadcast_ids", "pairs_at_once", "dense_share"), [(2048, 65_536, 500_000, 2_000_000, 1 / 64), (7, 4, 500_000, 50, 2.0), (3, 20, 0, 7, 0.0), (16, 50, 500_000, 300, 0.3)])
def test_pairs(spark, item_block, record_block, broadcast_ids, pairs_at_once, dense_share):
    rng = random.Random(6)
    rows = [(b, f"i{rng.randrange(60):02}") for b in range(150) for _ in range(rng.randrange(1, 5))] + [(b, f"p{b % 9}{x}") for b in range(150) for x in "ab" if b % 3]
    rows += [(1000 + b, f"i{k:02}") for b in range(6) for k in range(b, 60, 2)] + [(2000 + b, f"only-heavy-{k}") for b in range(7) for k in range(90)]
    rows += rows[:80] + [(None, "i01"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "transaction_id bigint, item_id string").repartition(5).withColumn("pair", F.lit(1))
    out = pairs_together(df, min_common=5, min_lift=2, item_block=item_block, record_block=record_block, broadcast_ids=broadcast_ids, pairs_at_once=pairs_at_once, dense_share=dense_share)
    found = {(r["item_a"], r["item_b"], r["common"]) for r in out.collect()}
    expected = _pairs(rows, 5, 2)
    assert found == expected
    assert any("HEAVY" in a for a, _, _ in expected)


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, "A")], "transaction_id bigint, item_id string")
    assert pairs_together(df).collect() == []
    assert pairs_together(df.limit(0)).collect() == []
