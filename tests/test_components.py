import random

import pytest
from pyspark.sql import functions as F

from edgewise.operators.components import NodeIds, graph_solver, propagate_minimum, super_merger, super_merger_weighted

F1 = ["A-B", "B-C", "C-D", "E-F", "F-G", "G-J", "I-K", "I-J", "AA-Z"]


def edges(spark, pairs, *more):
    rows = [(i, *(p.split("-") if isinstance(p, str) else p), *(m[i] for m in more)) for i, p in enumerate(pairs)]
    extra = "".join(f", w{k} double" for k in range(len(more)))
    return spark.createDataFrame(rows, f"pos bigint, `from` string, `to` string{extra}")


def groups(df):
    return [r["group"] for r in df.orderBy("pos").collect()]


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(
    ("pairs", "expected"),
    [
        (F1, [1, 1, 1, 2, 2, 2, 2, 2, 3]),
        (F1[:7], [1, 1, 1, 2, 2, 2, 3]),
        (["A-B", "B-C", "C-A"], [1, 1, 1]),
        ([("A", "B"), ("A", None), (None, "A"), ("Q", None), ("X", "X")], [1, 1, 0, 0, 2]),
    ],
)
def test_first_appearance(spark, pairs, expected):
    assert groups(super_merger(edges(spark, pairs), "from", "to", order_by="pos")) == expected


def test_order_decides_the_numbers(spark):
    df = edges(spark, ["Z-Y", "A-B"])
    assert groups(graph_solver(df, "from", "to")) == [2, 1]
    assert groups(graph_solver(df, "from", "to", order_by="pos")) == [1, 2]


def test_weighted(spark):
    df = edges(spark, ["A-B", "B-C", "C-D", "D-E", "E-A", "E-A"], [0.9, 0.2, 0.05, 0.8, 0.3, None])
    out = super_merger_weighted(df, "from", "to", "w0", 0.3, order_by="pos")
    assert [(r["pos"], r["group"]) for r in out.orderBy("pos").collect()] == [(0, 1), (3, 1), (4, 1)]


def test_empty_and_schema(spark):
    out = super_merger(edges(spark, []), "from", "to", order_by="pos")
    assert out.count() == 0
    assert dict(out.dtypes)["group"] == "bigint"


def test_clashing_columns_stay(spark):
    df = edges(spark, ["A-B", "C-D"]).select("*", F.lit(7).alias("GROUP"), F.lit(1).alias("node"), F.lit(2).alias("k0"), F.lit(3).alias("root"))
    out = super_merger(df, "from", "to")
    assert out.columns == ["pos", "from", "to", "node", "k0", "root", "group"]
    assert [(r["node"], r["k0"], r["root"], r["group"]) for r in out.orderBy("pos").collect()] == [(1, 2, 3, 1), (1, 2, 3, 2)]


def test_integers_are_strings(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "pos bigint, a bigint, b bigint")
    assert groups(super_merger(df, "a", "b")) == [1, 1]


def test_partition_by(spark):
    df = spark.createDataFrame([(0, "x", "A", "B"), (1, "x", "C", "D"), (2, "y", "A", "C"), (3, None, "A", "B"), (4, "y", "C", "D")], "pos bigint, k string, `from` string, `to` string")
    out = super_merger(df, "from", "to", order_by="pos", partition_by=["k"])
    assert groups(out) == [1, 2, 1, 1, 1]


@pytest.mark.parametrize("local_pairs", [0, 10, 100_000])
def test_propagation_against_union_find(spark, local_pairs):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5040)] + [(7, 7)]
    ids = {x: rng.getrandbits(62) - 2**61 for x in range(6000)}
    df = spark.createDataFrame([tuple(sorted((ids[a], ids[b]))) for a, b in pairs], "a bigint, b bigint")
    labels = propagate_minimum(df, local_pairs=local_pairs)
    expected = union_find(pairs)
    rows = labels.add(spark.createDataFrame([(ids[x],) for x in expected], "id bigint"), root="id").collect()
    labels.drop()
    found = {r["id"]: r["root"] for r in rows}
    assert len(rows) == len(found) == len(expected)
    by_root = {}
    for x, root in expected.items():
        by_root.setdefault(root, set()).add(found[ids[x]])
    assert all(len(s) == 1 for s in by_root.values())
    assert len({next(iter(s)) for s in by_root.values()}) == len(by_root)


def test_same_result_for_any_partitioning(spark):
    rng = random.Random(2)
    df = edges(spark, [f"n{rng.randrange(60)}-n{rng.randrange(60)}" for _ in range(50)])
    results = [groups(super_merger(df.repartition(n), "from", "to", order_by="pos")) for n in (1, 5)]
    assert results[0] == results[1]


@pytest.mark.parametrize("few", [True, False])
def test_names_that_share_their_hash(spark, monkeypatch, few):
    """Three bits for sixty names: nearly every hash is shared."""
    names = spark.createDataFrame([(f"n{i:02}",) for i in range(60)], "node string")
    ids = NodeIds.of(names, bits=3)
    ids.few = few
    found = {r["node"]: r["id"] for r in ids.add(names, id="node").collect()}
    assert len(found) == len(set(found.values())) == 60
    assert ids.add(spark.createDataFrame([(None,)], "node string"), id="node").first()["id"] is None


def test_groups_when_all_hashes_meet(spark, monkeypatch):
    from edgewise.operators import components

    plain = components.name_hash
    monkeypatch.setattr(components, "name_hash", lambda name, bits=63: plain(name, 2))
    assert groups(super_merger(edges(spark, [*F1, ("Q", None)]), "from", "to", order_by="pos")) == [1, 1, 1, 2, 2, 2, 2, 2, 3, 0]


def test_expressions(spark):
    """Ends, order and keys may be expressions, also of struct fields."""
    df = edges(spark, ["a-B", "b-c", "D-e", "E-d"]).select(F.struct("from", "to").alias("pair"), "pos")
    ends = (F.upper("pair.from"), F.upper(F.col("pair.to")))
    assert groups(super_merger(df, *ends, order_by=-F.col("pos"))) == [2, 2, 1, 1]
    assert groups(graph_solver(df, *ends, order_by="pos", partition_by=[F.col("pos") < 1])) == [1, 1, 2, 2]
    assert groups(super_merger_weighted(df, *ends, F.col("pos") / 10, 0.1, order_by="pos")) == [1, 2, 2]
