import pytest
from pyspark.sql import functions as F

from edgewise.operators.rules import graph_association_rules

TX = [(1, "A", 1.0), (1, "B", 2.0), (1, "C", 1.0), (2, "B", 1.0), (2, "D", 1.0), (3, "A", 1.0)]


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos bigint, t bigint, i string, f double")


def rules(df, frequency="f", **kw):
    out = graph_association_rules(df, "t", "i", frequency, order_by="pos", **kw)
    assert [t for _, t in out.dtypes] == ["string", "double", "double", "bigint", "array<string>", "array<double>"]
    return {r["item"]: r for r in out.collect()}


def check(found, item, support, lift, pattern, consequents, scores):
    r = found[item]
    assert (r["support"], r["pattern"], r["consequents"]) == (support, pattern, consequents)
    assert r["lift_score"] == pytest.approx(lift)
    assert r["confidence_scores"] == pytest.approx(scores)


def test_weighted(spark):
    found = rules(table(spark, TX), min_support=0.1, weighted=True)
    assert len(found) == 4
    check(found, "A", 2, 1.5, 1, ["B", "C"], [1, 0.5])
    check(found, "B", 3, 5 / 3, 1, ["A", "C", "D"], [2 / 3, 2 / 3, 1 / 3])
    check(found, "C", 1, 3, 1, ["B", "A"], [2, 1])
    check(found, "D", 1, 1, 1, ["B"], [1])


def test_unweighted(spark):
    found = rules(table(spark, TX), min_support=0.1)
    check(found, "A", 2, 4 / 3, 1, ["B", "C"], [2 / 3] * 2)
    check(found, "B", 2, 2, 1, ["A", "C", "D"], [2 / 3] * 3)
    check(found, "C", 1, 2 / 3, 1, ["A", "B"], [1 / 3] * 2)
    check(found, "D", 1, 1 / 3, 1, ["B"], [1 / 3])
    assert rules(table(spark, TX), frequency=None, min_support=0.1) == found


def test_single_item_has_empty_lists(spark):
    found = rules(table(spark, [(1, "A", 1.0), (2, "A", 1.0), (3, "A", 1.0)]))
    check(found, "A", 3, 0, 1, [], [])


def test_min_support_and_patterns(spark):
    found = rules(table(spark, [(1, "A", 1.0), (1, "B", 1.0), (2, "B", 1.0), (3, "C", 1.0), (4, "C", 1.0)]), min_support=0.5)
    assert {i: r["pattern"] for i, r in found.items()} == {"B": 1, "C": 2}


def test_entries_are_not_merged(spark):
    df = table(spark, [(1, "A", 1.0), (1, "B", 2.0), (2, "A", 2.0), (2, "B", 1.0)])
    check(rules(df, weighted=True), "A", 3, 4 / 3, 1, ["B", "B"], [2 / 3, 2 / 3])
    check(rules(df), "A", 2, 2, 1, ["B", "B"], [1, 1])


def test_oversized_transaction(spark):
    found = rules(table(spark, [(1, f"i{k:02}", 1.0) for k in range(51)]))
    assert len(found) == 51
    assert all((r["support"], r["lift_score"], r["consequents"]) == (1, 0, []) for r in found.values())
    assert sorted(r["pattern"] for r in found.values()) == list(range(1, 52))


def test_nulls_nan_and_bad_ids(spark):
    found = rules(table(spark, [(1, "A", 1.0), (1, "B", None), (None, "C", 1.0), (2, None, 1.0), (2, "D", 1.0)]))
    check(found, "A", 1, 0, 1, [], [])
    check(found, "D", 1, 0, 2, [], [])
    assert len(found) == 2
    weighted = rules(table(spark, [(1, "A", float("nan")), (1, "B", 1.0), (1, "C", -1.0)]), weighted=True)
    assert set(weighted) == {"B"}
    text = spark.createDataFrame([(0, "T1", "A", 1.0), (1, "7", "B", 1.0)], "pos bigint, t string, i string, f double")
    assert set(rules(text)) == {"B"}


def test_empty_and_clashing_columns(spark):
    assert rules(table(spark, [])) == {}
    df = table(spark, TX).select("*", *(F.lit(0).alias(c) for c in ("id", "item", "cnt", "support", "size")))
    assert len(rules(df, min_support=0.1)) == 4


def test_longer_pattern_chain(spark):
    rows = [(k, f"i{k:02}", 1.0) for k in range(9)] + [(k, f"i{k + 1:02}", 1.0) for k in range(9)] + [(50, "z", 1.0)]
    found = rules(table(spark, rows), min_support=0.01, min_confidence=0.01)
    assert {r["pattern"] for i, r in found.items() if i != "z"} == {1}
    assert found["z"]["pattern"] == 2


def test_each_key_has_its_own_rules(spark):
    rows = [(i, "xyz"[i % 3] if i % 7 else None, i % 5, "ABCD"[i * i % 4], float(i % 3 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "pos bigint, k string, t bigint, i string, f double")
    run = lambda d, **kw: graph_association_rules(d, "t", F.lower("i"), "f", 0.01, 0.01, weighted=True, order_by="pos", **kw)
    found = {(r["k"], r["item"]): r for r in run(df, partition_by=["k"]).collect()}
    alone = {(k, r["item"]): r for k in ("x", "y", "z", None) for r in run(df.filter(F.col("k").eqNullSafe(k))).collect()}
    assert set(found) == set(alone)
    for key, r in alone.items():
        assert [found[key][c] for c in ("support", "pattern", "consequents")] == [r[c] for c in ("support", "pattern", "consequents")]
        assert found[key]["lift_score"] == pytest.approx(r["lift_score"])
