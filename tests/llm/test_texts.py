"""Containers, mixing and subjects."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.clustering import BisectingKMeans
from pyspark.sql import functions as F

from conftest import DATA
from edgewise.llm.main_text import repair, sentences
from edgewise.llm.p7_pack import container_use, fill, fill_containers, pack
from edgewise.llm.p8_mix import mix_sources
from edgewise.llm.p9_subjects import LeafTerms, described_terms, document_subjects, leaf_families
from edgewise.llm.sizes import bpe_tokens, byte_tokens
from edgewise.store import path_of


def _best_fill(counts, capacity):
    reach = {0}
    for length, n in counts.items():
        for _ in range(n):
            reach |= {x + length for x in reach if x + length <= capacity}
    return max(reach)


def test_fill_is_as_close_as_any():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randrange(10, 120)
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 6) for _ in range(rng.randrange(1, 7))}
        lengths = sorted(counts, reverse=True)
        used = fill(lengths, counts, capacity)
        assert all(0 < n <= counts[length] for length, n in used.items())
        rest = dict(counts)
        rest[lengths[0]] -= 1
        assert used[lengths[0]] >= 1
        assert sum(length * n for length, n in used.items()) == lengths[0] + _best_fill(rest, capacity - lengths[0])


def test_pack_fills_each_container_once():
    rng = np.random.default_rng(2)
    sizes = np.r_[rng.integers(1, 400, 3000), np.full(1500, 333), np.zeros(3, int)]
    places = pack(sizes, 1000)
    used = np.bincount(places, sizes)
    assert used.max() <= 1000
    assert used.sum() == sizes.sum()
    assert used[:-1].min() >= 999


def test_containers(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([0, 10, 500, 900, 90, 3300])) for i in range(500)] + [(None, "é" * 40), (7, "y" * 99), (7, "y" * 99), (9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("key", F.lit(1))
    packed = fill_containers(df, capacity=1000, shard_containers=50).collect()
    expected = Counter((i, len(t.encode()) + 1) for i, t in rows if t is not None)
    pieces = defaultdict(list)
    for r in packed:
        pieces[r["key"], r["pieces"]].append((r["start"], r["length"]))
    found = Counter()
    for (key, n), parts in pieces.items():
        if n == 1:
            found.update((key, length) for _, length in parts)
        else:
            ordered = sorted(parts)
            assert len(ordered) == n
            assert all(a + length == b for (a, length), (b, _) in zip(ordered, ordered[1:]))
            assert all(length == 1000 for _, length in ordered[:-1])
            found[key, sum(length for _, length in ordered)] += 1
    assert found == expected
    used = Counter()
    for r in packed:
        used[r["container"]] += r["length"]
    assert max(used.values()) <= 1000
    assert all(n == 1 or size > 1000 for key, size in expected for (k, n) in pieces if k == key and size in [x for _, x in pieces[k, n]])


def test_use_of_containers(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    use = container_use(fill_containers(df)).first()
    assert use["fill"] > 0.97
    empty = container_use(fill_containers(df.limit(0))).first()
    assert (empty["containers"], empty["tokens"], empty["unused"], empty["fill"]) == (0, 0, 0, None)


def test_sizes(spark):
    import public_tokenizers as P
    import tiktoken  # noqa: F401

    df = spark.createDataFrame([("Some text – здесь",), ("",), (None,)], "text string")
    out = df.select(byte_tokens("text").alias("b"), bpe_tokens(F.col("text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).alias("t")).collect()
    assert [r["b"] for r in out] == [len("Some text – здесь".encode()) + 1, 1, None]
    assert out[0]["t"] > 3
    assert [r["t"] for r in out[1:]] == [0, None]


def _mix(spark, bucket_rows=250_000, parts=3):
    rows = [(i, s, "x" * (i % 50 + 20)) for i, s in enumerate(["big"] * 900 + [" Small.example\t"] * 40 + ["none"] * 30 + [None, ""] * 5)]
    rows += [(None, "big", "dup"), (None, "big", "dup"), (5000, "big", None)]
    targets = [("BIG", 0.5, 2), ("small.example", 0.4, 3), ("absent", 0.1, 4), (None, 0.2, 1)]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(parts).withColumn("size", F.lit("z"))
    return rows, mix_sources(documents, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), bucket_rows=bucket_rows)


@pytest.mark.parametrize("bucket_rows", [250_000, 50])
def test_mix(spark, bucket_rows):
    rows, mix = _mix(spark, bucket_rows)
    report = {r["source"]: r for r in mix.report.collect()}
    sizes = defaultdict(int)
    for _, s, t in rows:
        if t is not None and s and s.strip().lower() in ("big", "small.example"):
            sizes[s.strip().lower()] += len(t) + 1
    total = sum(sizes.values())
    assert set(report) == {"big", "small.example", "absent"}
    assert {s: r["size"] for s, r in report.items()} == {**sizes, "absent": 0}
    assert {s for s, r in report.items() if r["short"]} == {s for s, share, cap in [("big", 0.5, 2), ("small.example", 0.4, 3), ("absent", 0.1, 4)] if sizes[s] * cap < share * total}
    drawn = mix.rows.collect()
    per = Counter((r["doc_id"], r["source"]) for r in drawn if r["doc_id"] is not None)
    rate = 0.5 * total / sizes["big"]
    assert {per[i, "big"] for i in range(900)} <= {int(rate), int(rate) + 1}
    assert all(per[i, "small.example"] == 3 for i in range(900, 940))  # short: everything, as often as it may
    assert abs(sum(n for (i, s), n in per.items() if s == "big") - 900 * rate) <= 4
    assert report["big"]["reached"] == pytest.approx(0.5 * total, rel=0.02)
    assert sum(r["reached_share"] for r in report.values()) == pytest.approx(1.0)
    assert {s: r["reached"] for s, r in report.items()} == {s: sum(r["size"] for r in drawn if r["source"] == s) for s in report}


def test_mix_is_drawn_whatever_is_asked(spark):
    """The report is written with its totals, so a query that needs only ``short`` can't leave the draw out."""
    _, mix = _mix(spark)
    written = {r["source"]: (r["copies"], r["reached"]) for r in spark.read.parquet(path_of(mix.report)).collect()}
    drawn = mix.rows.groupBy("source").agg(F.count("*").alias("copies"), F.sum("size").alias("reached")).collect()
    assert written == {"absent": (0, 0)} | {r["source"]: (r["copies"], r["reached"]) for r in drawn}


def test_mix_is_the_same_for_any_partitioning(spark):
    draws = [sorted((r["doc_id"] or -1, r["source"], r["copy"]) for r in _mix(spark, 50, parts)[1].rows.collect()) for parts in (1, 6)]
    assert draws[0] == draws[1]


@pytest.mark.parametrize("total", [2, 2_999_999])
def test_mix_of_many_documents_is_exact(spark, total):
    """Also where a document has less than a millionth of a copy, or nearly one."""
    documents = spark.range(3_000_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix_sources(documents, targets, size=F.lit(1), total=total).report.first()["copies"] == total


def test_mix_of_a_reachable_total(spark):
    """Every source that has documents gives its share."""
    documents = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50, "small").otherwise("big").alias("source"))
    targets = spark.createDataFrame([("small", 0.25, 4), ("big", 0.5, 1), ("absent", 0.25, 1)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mix_sources(documents, targets, size=F.lit(10), total="reachable").report.collect()}
    assert {s: r["reached"] for s, r in report.items()} == {"small": 2000, "big": 4000, "absent": 0}
    assert not report["small"]["short"] and not report["big"]["short"]
    assert mix_sources(documents.limit(0), targets, size=F.lit(1), total="reachable").rows.count() == 0


def test_mix_of_nothing(spark):
    documents = spark.createDataFrame([], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix = mix_sources(documents, targets)
    assert mix.rows.count() == 0
    assert [(r["source"], r["reached"], r["reached_share"]) for r in mix.report.collect()] == [("a", 0, 0.0)]
    assert mix_sources(documents, targets.limit(0)).report.count() == 0


def test_repair():
    russian, german = "Здоровье и музыка. Сначала газон, потом компост. Для города важны сад и обрезка.", "Über „Gewächshaus“ wird gestritten – größtenteils."
    assert repair(russian) == russian
    assert repair(german) == german
    assert repair(russian.encode().decode("latin-1")) == russian
    assert repair(german.encode().decode("cp1252", "replace")).count("�") <= 2
    assert repair(german.encode("cp1252").decode("latin-1")) == german
    assert repair(russian.encode("koi8-r").decode("cp1251")) == russian
    assert repair(russian.encode("cp1251").decode("latin-1")) == russian


def test_sentences():
    page = """Science | Law | Sport | Sign in
This site stores cookies on your device. By reading on you agree.
Questions about the balance
Questions about the balance came up 29 times. “We kept the bank,” said Lanaba, “because it came too late.” The rest is easily told.
In Lor they start with the magnet and leave …
Nobody had expected it.
© 2020 hollow.example · Terms · Privacy"""
    assert len(sentences(page)) == 4
    assert sentences(None) == sentences("") == sentences("a\nb | c\n©") == []
    assert len(sentences("Ein Satz hier. „Noch einer“, sagte sie. " * 20_000)) == 40_000


def test_sentences_of_a_cut_paragraph():
    whole = "The scale fits the dough. Is it worth it? “We kept the bank,” said Lanaba."
    assert len(sentences(f"A first paragraph. It ends.\n{' '.join([whole] * 40)} Whoever has a whi")) == 2 + 3 * 40
    assert sentences(f"{whole} Whoever has a whi") == sentences(whole)
    assert len(sentences("Few people had seen it. It rained that morning. �We kept it,� said Melvalla, �because it came late.�")) == 2
    assert sentences("Your privacy: 476 partners would like to store data. Manage choices") == []
    assert sentences("? 2023 delta.example ? Terms of use ? Privacy of readers ? Contact") == []
    assert sentences("Dr. Meier | Tel. 030 12 | Str. 5 | Contact") == []


def test_a_paragraph_about_cookies_is_no_notice():
    paragraph = "The cookies go into the oven last. Nobody had expected it. The batch was late."
    assert len(sentences(f"This site stores cookies on your device. By reading on you agree.\n{paragraph}")) == 3
    assert sentences("We use cookies to improve your visit. Accept all | Reject | Settings") == []
    assert len(sentences("Whoever bakes cookies should look after the dough " + "and the flour " * 15 + "for days.")) == 1


@pytest.fixture(scope="module")
def corpus(spark):
    subjects = {"law": "court judge verdict statute plaintiff attorney clause trial".split(), "music": "violin melody concerto drummer chord album soprano trial".split(), "travel": "ferry suitcase hostel visa airport lodge guidebook pass".split()}
    frames = ["Questions about the {} and the {} came up {} times.", "Whoever has a {} should look after the {} for {} days.", "You can read more about {} and {} in chapter {}."]
    rng, rows, truth, labels = random.Random(8), [], defaultdict(set), []
    for i in range(700):
        own = rng.sample(sorted(subjects), rng.choice([1, 1, 2]))
        parts = [s for k, s in enumerate(own) for _ in range(6)]
        text = " ".join(rng.choice(frames).format(*rng.choices(subjects[s], k=2), rng.randrange(90)) for s in parts) + " The rest is easily told."
        rows.append((i, f"Law | Music\n{text}\n© 2020 · Terms"))
        truth[i] = set(own)
        if i % 3 == 0:
            labels += [(i, s.upper() + " ") for s in own]
    rows += [(10_000, None), (10_001, ""), (10_002, "Law | Music\nSorry, this page could not be found."), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("leaf", F.lit(1)).withColumn("terms", F.lit("t"))
    areas = spark.createDataFrame([(s, "about") for s in subjects], "subject string, about string")
    return frame, spark.createDataFrame(labels, "doc_id bigint, subject string"), areas, truth


def test_subjects(spark, corpus):
    frame, labels, areas, truth = corpus
    found = defaultdict(set)
    for r in document_subjects(frame, labels, areas, leaves=16).collect():
        found[r["doc_id"]].add(r["subject"])
    held_out = [i for i in truth if i % 3]
    assert sum(found[i] == truth[i] for i in held_out) >= 0.95 * len(held_out)
    assert not {10_000, 10_001, 10_002} & set(found)
    assert found[None] == found[0]


def test_subjects_by_a_tree_of_a_sample(spark, corpus):
    frame, labels, areas, truth = corpus
    found = defaultdict(set)
    for r in document_subjects(frame, labels, areas, leaves=16, fit_documents=150).collect():
        found[r["doc_id"]].add(r["subject"])
    assert sum(found[i] == truth[i] for i in truth) >= 0.95 * len(truth)


def test_subjects_by_a_tree_of_all_documents(spark, corpus, monkeypatch):
    """Of more than 20,000 documents all are in the tree's fit, as many in each task."""
    frame, labels, areas, truth = corpus
    frame = frame.filter("doc_id < 10000").crossJoin(spark.range(30).select(F.col("id").alias("copy"))).select((F.col("doc_id") + 100_000 * F.col("copy")).alias("doc_id"), "text")
    fit, seen, found = BisectingKMeans.fit, [], defaultdict(set)

    def recorded(self, rows, *args):
        seen.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
        return fit(self, rows, *args)

    monkeypatch.setattr(BisectingKMeans, "fit", recorded)
    for r in document_subjects(frame, labels, areas, leaves=16).collect():
        found[r["doc_id"]].add(r["subject"])
    assert [sum(parts) for parts in seen] == [30 * len(truth)]
    assert max(seen[0]) <= 1.1 * min(seen[0])
    assert sum(found[100_000 * k + i] == truth[i] for k in range(30) for i in truth) >= 0.95 * 30 * len(truth)


def test_held_out_labels(spark):
    """With the labels of half of the labelled documents, the subjects of the other half: of the middle size nine in ten."""
    table = lambda name: spark.read.parquet(f"{DATA}/sf0.1/{name}.parquet")
    labels = table("subject_labels").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    told, kept = labels.filter("half = 0").drop("half"), labels.filter("half = 1")
    found = {(r["doc_id"], r["subject"]) for r in document_subjects(table("documents"), told, table("subject_areas")).join(kept.select("doc_id").distinct(), "doc_id").collect()}
    expected = {(r["doc_id"], r["subject"].strip().lower()) for r in kept.collect()}
    assert len(found & expected) >= 0.9 * len(expected)
    assert len(found & expected) >= 0.9 * len(found)


def test_described_terms():
    found = described_terms(["contract", "vertrag", "contrat", "con", "match", "mat", "courtyard"], ["courts, contracts", "matches"])
    assert found.tolist() == [[1, 0, 1, 0, 0, 0, 0], [0, 0, 0, 0, 1, 0, 0]]


def test_sparse_counts_of_leaves():
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 3, (5, 40)) * (rng.random((5, 40)) < 0.4)
    leaf, term = np.nonzero(dense)
    order = rng.permutation(len(leaf))
    sizes = np.array([4, 5, 6, 7, 0])
    dense[4] = 0
    keep = order[leaf[order] < 4]
    whole = np.arange(4)
    table = LeafTerms(np.r_[leaf[keep], whole], np.r_[term[keep], np.full(4, 40)], np.r_[dense[leaf[keep], term[keep]], sizes[:4]].astype(float), 5, 40)
    assert (table.sizes == sizes).all()
    assert (table.total() == dense.sum(axis=0)).all()
    assert (table.total(np.array([True, False, True, False, False])) == dense[[0, 2]].sum(axis=0)).all()
    at, count = table.own(3)
    assert (dense[3, at] == count).all() and count.sum() == dense[3].sum()
    rates = dense[:4] / sizes[:4, None]
    unit = rates / np.linalg.norm(rates, axis=1, keepdims=True)
    family = leaf_families(table, block=7)
    assert all((family[i] == family[j]) >= (unit[i] @ unit[j] >= 0.5) for i in range(4) for j in range(4))
    assert (family == family[4]).sum() == 1


def test_subject_of_few_documents(spark, corpus):
    """The words of a subject in less than 1/250 of the documents are evidence too."""
    frame, labels, areas, _ = corpus
    copies = [frame.withColumn("doc_id", F.col("doc_id") + 100_000 * k) for k in range(4)]
    words, rng = "turbine glider runway cockpit rudder fuselage altimeter hangar".split(), random.Random(4)
    rows = [(-1 - i, " ".join(f"Whoever has a {a} should look after the {b}." for a, b in zip(rng.sample(words, 8), rng.sample(words, 8)))) for i in range(9)]
    frame = copies[0].unionByName(copies[1]).unionByName(copies[2]).unionByName(copies[3]).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    labels = labels.union(spark.createDataFrame([(-1 - i, "aviation") for i in range(5)], "doc_id bigint, subject string"))
    areas = areas.union(spark.createDataFrame([("aviation", "about")], "subject string, about string"))
    found = document_subjects(frame, labels, areas, leaves=16).filter("doc_id < 0").collect()
    assert {(r["doc_id"], r["subject"]) for r in found} == {(-1 - i, "aviation") for i in range(9)}


def test_subjects_of_nothing(spark, corpus):
    frame, labels, areas, _ = corpus
    for args in ((frame.limit(0), labels, areas), (frame, labels.limit(0), areas), (frame, labels, areas.limit(0))):
        assert document_subjects(*args, leaves=4).collect() == []
