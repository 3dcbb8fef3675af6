import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from edgewise.operators.betweenness import betweenness_centrality
from edgewise.operators.pagerank import page_rank, page_rank_nodes
from edgewise.operators.paths import calculate_shortest_path

from test_components import F1, edges

# Arrays, and the loops over tables that large graphs take.
LOCAL = pytest.mark.parametrize("local", [0, 200_000])
README = ["A-B", "A-C", "B-C", "C-D", "D-E", "E-A"]


def test_page_rank_rows(spark):
    out = page_rank(edges(spark, F1), "from", "to").orderBy("pos").collect()
    low, mid, high = 0.012500000000000002, 0.023125000000000007, 0.032156250000000004
    assert [r["pagerank"] for r in out] == pytest.approx([low, mid, high, low, mid, high, low, low, low], abs=1e-15)


@LOCAL
def test_page_rank_nodes(spark, local):
    out = {r["node"]: r for r in page_rank_nodes(edges(spark, ["A-B", "A-C", "B-C", "C-A", "D-B"]), "from", "to", local_edges=local).collect()}
    assert {k: r["score"] for k, r in out.items()} == pytest.approx({"A": 0.3602739633141251, "B": 0.22249163988406387, "C": 0.379734396801811, "D": 0.037500000000000006}, abs=1e-12)
    assert out["A"]["iterations"] == 28


def test_page_rank_edges_of_the_input(spark):
    df = edges(spark, [("A", "B"), (None, "A"), ("Q", None), ("A", "B")])
    out = [r["pagerank"] for r in page_rank(df, "from", "to", max_iterations=0).orderBy("pos").collect()]
    assert out == [0.5, 0.0, 0.0, 0.5]
    assert page_rank(edges(spark, []), "from", "to").count() == 0
    assert page_rank_nodes(edges(spark, []), "from", "to").columns == ["node", "score", "iterations"]


@LOCAL
def test_page_rank_dangling(spark, local):
    scores = page_rank_nodes(edges(spark, F1), "from", "to", redistribute_dangling=True, max_iterations=6, local_edges=local).collect()
    assert sum(r["score"] for r in scores) == pytest.approx(1.0)
    assert sum(r["score"] for r in page_rank_nodes(edges(spark, F1), "from", "to").collect()) == pytest.approx(0.286478125)


def paths(df, **kw):
    return {(r["from"], r["to"]): r["distance"] for r in calculate_shortest_path(df, "from", "to", "w0", **kw).collect()}


def test_paths(spark):
    df = edges(spark, ["A-B", "A-C", "B-C", "C-D"], [1.0, 2.0, 1.0, 1.5])
    expected = {("A", "B"): 1.0, ("A", "C"): 2.0, ("A", "D"): 3.5, ("B", "C"): 1.0, ("B", "D"): 2.5, ("C", "D"): 1.5}
    assert paths(df) == expected
    assert paths(df, directed=True) == expected
    assert calculate_shortest_path(df, "from", "to", "w0", directed=True, duplicate_pairs=True).count() == 12


def test_paths_directed_cycle(spark):
    df = edges(spark, ["A-B", "B-C", "B-A", "C-A"], [1.0, 2.0, 3.0, 4.0])
    assert paths(df, directed=True) == {("A", "B"): 1, ("B", "A"): 3, ("A", "C"): 3, ("C", "A"): 4, ("B", "C"): 2, ("C", "B"): 5}


def test_paths_cut_weights_and_nulls(spark):
    df = edges(spark, ["A-B", ("B", None), "B-C", ("C", "C")], [1.001, -5.0, None, 2.0])
    assert paths(df) == {("A", "B"): 1.0}
    assert paths(edges(spark, ["A-B"], [0.0005])) == {("A", "B"): 0.0}
    assert paths(edges(spark, [], [])) == {}


@pytest.mark.parametrize("weight", [-1.0, math.nan, math.inf])
def test_paths_reject(spark, weight):
    with pytest.raises(Exception, match="finite and not negative"):
        paths(edges(spark, ["A-B"], [weight]))


@LOCAL
@pytest.mark.parametrize("directed", [False, True])
def test_paths_against_floyd(spark, directed, local):
    rng = random.Random(3)
    pairs, w = [f"n{rng.randrange(14)}-n{rng.randrange(14)}" for _ in range(30)], [rng.randrange(1, 50) / 4 for _ in range(30)]
    nodes = sorted({x for p in pairs for x in p.split("-")})
    d = defaultdict(lambda: math.inf)
    for p, x in zip(pairs, w):
        a, b = p.split("-")
        d[a, b] = min(d[a, b], x)
        if not directed:
            d[b, a] = min(d[b, a], x)
    for k, i, j in itertools.product(nodes, nodes, nodes):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    expected = {(i, j): d[i, j] for i in nodes for j in nodes if i != j and d[i, j] < math.inf and (directed or i < j)}
    assert paths(edges(spark, pairs, w), directed=directed, local_edges=local) == pytest.approx(expected)


def central(df, **kw):
    return {r["node"]: r["centrality"] for r in betweenness_centrality(df, "from", "to", **kw).collect()}


def _brandes(pairs, directed):
    """Path counting over all triples."""
    out = defaultdict(Counter)
    for p in pairs:
        a, b = p.split("-")
        if a != b:
            out[a][b] += 1
            if not directed:
                out[b][a] += 1
    nodes = sorted({x for p in pairs for x in p.split("-")})
    depth, sigma = {}, {}
    for s in nodes:
        depth[s, s], sigma[s, s], level = 0, 1, [s]
        while level:
            following = Counter()
            for v in level:
                for w, m in out[v].items():
                    if (s, w) not in depth:
                        following[w] += sigma[s, v] * m
            for w, m in following.items():
                depth[s, w], sigma[s, w] = depth[s, level[0]] + 1, m
            level = list(following)
    scores = dict.fromkeys(nodes, 0.0)
    for s, v, t in itertools.permutations(nodes, 3):
        if (s, t) in depth and (s, v) in depth and (v, t) in depth and depth[s, v] + depth[v, t] == depth[s, t]:
            scores[v] += sigma[s, v] * sigma[v, t] / sigma[s, t]
    return {v: x * (1 if directed else 0.5) for v, x in scores.items()}


@LOCAL
@pytest.mark.parametrize("directed", [False, True])
def test_betweenness_against_path_counting(spark, directed, local):
    rng = random.Random(7)
    pairs = [f"n{rng.randrange(16)}-n{rng.randrange(16)}" for _ in range(26)]
    assert central(edges(spark, pairs), directed=directed, normalized=False, local_edges=local) == pytest.approx(_brandes(pairs, directed))


def test_betweenness(spark):
    assert central(edges(spark, ["A-B", "B-C"])) == {"A": 0, "B": 1, "C": 0}
    assert central(edges(spark, ["A-B", "A-C", "A-D", "A-E"])) == {"A": 1, "B": 0, "C": 0, "D": 0, "E": 0}
    assert central(edges(spark, ["A-B", "B-C", "D-E"])) == pytest.approx({"A": 0, "B": 1 / 6, "C": 0, "D": 0, "E": 0})
    assert central(edges(spark, README)) == pytest.approx({"A": 0.25, "B": 0, "C": 0.25, "D": 1 / 12, "E": 1 / 12})
    triangle = edges(spark, ["A-B", "B-C", "C-A"])
    assert central(triangle, directed=True) == {"A": 0.5, "B": 0.5, "C": 0.5}
    assert central(triangle) == {"A": 0, "B": 0, "C": 0}


def test_betweenness_parallel_edges_and_batches(spark):
    df = edges(spark, ["A-B", "A-B", "B-C", "A-D", "D-C"])
    expected = {"A": 0, "B": 2 / 3, "C": 0, "D": 1 / 3}
    assert central(df, directed=True, normalized=False) == pytest.approx(expected)
    assert central(df, directed=True, normalized=False, batches=3, local_edges=0) == pytest.approx(expected)


def test_betweenness_small_and_empty(spark):
    assert all(math.isnan(x) for x in central(edges(spark, ["A-B", (None, "Q")])).values())
    assert central(edges(spark, [])) == {}
    assert central(edges(spark, ["A-A", "A-B", "B-C"]))["B"] == 1


KEYED = [("x", "A", "B", 1.0), ("x", "B", "C", 2.0), ("y|1", "A", "B", 5.0), ("y|1", "B", "A", 0.5), (None, "A|", "Z", 1.0), ("x", "C", None, 1.0), ("x", "C", "A", 7.0), ("y|1", "Q", "A", 2.0)]


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(KEYED)], "pos bigint, k string, `from` string, `to` string, w double")


def rows_of(*frames):
    """All rows, sorted; numbers to nine digits."""
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted([plain(v) for v in r] for df in frames for r in df.collect())


@LOCAL
def test_scores_of_each_key(spark, keyed, local):
    """Each key's graph as if it were alone, whatever the keys and names hold."""
    few = {"local_edges": local, "max_iterations": 3, "convergence_threshold": 0.3}
    same = [
        lambda df, **kw: calculate_shortest_path(df, "from", "to", "w", directed=True, local_edges=local, **kw),
        lambda df, **kw: page_rank_nodes(df, "from", "to", redistribute_dangling=True, **few, **kw),
        lambda df, **kw: betweenness_centrality(df, "from", "to", local_edges=local, **kw),
    ]
    for run in same:
        found = run(keyed, partition_by=["k"])
        alone = [run(keyed.filter(keyed["k"].eqNullSafe(k))).selectExpr(f"{k!r} as k" if k else "null as k", "*") for k in ("x", "y|1", None)]
        assert found.columns == alone[0].columns
        assert rows_of(found) == rows_of(*alone)


def test_rows_of_each_key_have_their_score(spark, keyed):
    alone = {r["pos"]: r["pagerank"] for k in ("x", "y|1", None) for r in page_rank(keyed.filter(keyed["k"].eqNullSafe(k)), "from", "to").collect()}
    found = page_rank(keyed, "from", "to", partition_by=["k"])
    assert found.columns == ["pos", "k", "from", "to", "w", "pagerank"]
    assert {r["pos"]: r["pagerank"] for r in found.collect()} == pytest.approx(alone)


def test_expressions_of_struct_fields(spark, keyed):
    df = keyed.selectExpr("named_struct('f', lower(`from`), 't', lower(`to`)) as e", "w", "k")
    ends = (spark_upper("e.f"), spark_upper("e.t"))
    assert rows_of(calculate_shortest_path(df, *ends, df["w"] * 2, partition_by=[df["k"]]).drop("key0", "distance")) == rows_of(calculate_shortest_path(keyed, "from", "to", "w", partition_by=["k"]).drop("k", "distance"))
    assert rows_of(page_rank_nodes(df, *ends)) == rows_of(page_rank_nodes(keyed, "from", "to"))
    assert rows_of(betweenness_centrality(df, *ends)) == rows_of(betweenness_centrality(keyed, "from", "to"))


def spark_upper(column):
    from pyspark.sql import functions as F

    return F.upper(column)


def test_batches_of_sources(spark):
    df = edges(spark, README)
    one, many = ({r["node"]: r["centrality"] for r in betweenness_centrality(df, "from", "to", batches=n, local_edges=0).collect()} for n in (1, 3))
    assert one == pytest.approx(many)


def test_many_pairs_leave_the_arrays(spark, monkeypatch):
    """A graph of few edges whose result would be large goes by tables."""
    from edgewise.operators import paths as module

    df = edges(spark, ["A-B", "B-C", "C-D"], [1.0, 1.0, 1.0])
    expected = paths(df)
    monkeypatch.setattr(module, "LOCAL_PAIRS", 3)
    monkeypatch.setattr(module, "from_every_node", None)
    assert paths(df) == expected
