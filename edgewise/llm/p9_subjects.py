"""Subject areas of documents.

1. Main texts are cut into sentences and words (``main_text``); the words of
   all documents are counted, and those in a share of documents between
   ``min_share`` and ``max_share`` are the vocabulary.
2. Documents are normalised vectors of the vocabulary (occurrences times
   inverse document frequency), clustered by bisecting k-means into ``leaves``
   leaves: mostly one language and one or two subjects each.
3. Leaves are labelled by their discriminative terms: readers' labels say
   which terms speak for which subject, a leaf's discriminative terms then give
   its mixture of subjects, and so do labelled documents in the leaf. Terms
   are weighed within a leaf family (leaves that share their common words,
   which are the leaves of a language), so that common words say nothing.
4. The leaves' mixtures turn the terms of *all* documents into evidence for
   subjects. A document is then a mixture: it starts from its leaf's mixture;
   each sentence goes to the subject that its terms and the mixture speak for
   (none, if it has no discriminative term), and the mixture follows the
   sentences. The evidence of terms is counted again from these sentences
   ``rounds`` times. Subjects with at least ``share`` of the sentences of the
   main text are the document's.

Sums by subject and term, and by leaf and the terms that it has (sparse), go to
the driver as Arrow batches; the vocabulary has at most (distinct words of a
document) / ``min_share`` terms.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.llm.main_text import WORD, word_batches
from edgewise.store import drop, write_table

#: Labels that are broadcast if there are counted to be no more.
BROADCAST_LABELS = 500_000
#: Share of every subject in a leaf, whatever the leaf's terms say.
FLOOR = 0.02
#: Documents of one task of the tree's fit; the least documents of a leaf that is divided.
FIT_PART, MIN_LEAF = 20_000, 8.0


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each element, and the elements."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_parent_indices(column).to_numpy(), pc.list_flatten(column)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(terms) to (term, docs): documents that have each term."""
    parts: list[pa.Table] = []
    for batch in batches:
        rows, terms = _lists(batch.column(0))
        coded = terms.dictionary_encode()
        k = max(1, len(coded.dictionary))
        codes = np.unique(rows.astype(np.int64) * k + coded.indices.to_numpy()) % k
        parts.append(pa.table({"term": coded.dictionary, "docs": np.bincount(codes, minlength=len(coded.dictionary))}))
        if len(parts) >= 20:
            parts = [_merged(parts)]
    if parts:
        yield from _merged(parts).to_batches(max_chunksize=65_536)


def _merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("term").aggregate([("docs", "sum")]).rename_columns(["term", "docs"])


def _to_ids(vocabulary: list[str]):
    """(doc_id, sents, terms, at): terms of the vocabulary become their
    numbers, others fall away. A term whose letters beyond ASCII were lost is
    the term that it can only be."""
    known = {t: i for i, t in enumerate(vocabulary)}
    lost: dict[str, int] = {}
    for t, i in known.items():
        mask = "".join(c if c.isascii() else "�" for c in t)
        if mask != t and mask.strip("�"):
            lost[mask] = -1 if mask in lost else i
    aliases = known | {m: i for m, i in lost.items() if i >= 0}
    values, numbers = pa.array(list(aliases), pa.string()), np.array(list(aliases.values()), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms = _lists(batch.column(2))
            at = pc.list_flatten(batch.column(3)).to_numpy()
            found = pc.index_in(terms, values).to_numpy(zero_copy_only=False)
            keep = ~np.isnan(found) if found.dtype.kind == "f" else np.ones(len(found), bool)
            ids, rows, at = numbers[found[keep].astype(np.int64)], rows[keep], at[keep]
            offsets = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32()))], ["doc_id", "sents", "ids", "at"]
            )

    return run


def _dense(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sums of (i, j, w) as a matrix; its size is bounded by leaves, subjects and vocabulary."""
    out = np.zeros(shape)
    # As Arrow: rows of Python objects would take many times the matrix.
    for batch in rows.groupBy("i", "j").agg(F.sum("w").alias("w")).toArrow().to_batches():
        out[batch["i"].to_numpy(), batch["j"].to_numpy()] = batch["w"].to_numpy()
    return out


def _emit(counts: np.ndarray, offset: int = 0) -> Iterator[pa.RecordBatch]:
    i, j = np.nonzero(counts)
    yield from pa.table({"i": pa.array(i + offset, pa.int32()), "j": pa.array(j, pa.int32()), "w": counts[i, j]}).to_batches(max_chunksize=65_536)


def _group_terms(groups: int, terms: int):
    """(groups, ids), where ``groups`` are those that share the document, to
    sums (group, term): documents of a group that have a term; column
    ``terms`` counts the documents. For few groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((groups, terms + 1))
        for batch in batches:
            rows, ids = _lists(batch.column(1))
            pairs = np.unique(rows.astype(np.int64) * terms + ids.to_numpy())
            rows, ids = pairs // terms, pairs % terms
            owner, member = _lists(batch.column(0))
            member, weight = member.to_numpy(), 1.0 / np.bincount(owner, minlength=batch.num_rows)[owner]
            first = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            n = (first[1:] - first[:-1])[owner]
            at = np.repeat(first[owner], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            np.add.at(sums, (np.repeat(member, n), ids[at]), np.repeat(weight, n))
            np.add.at(sums, (member, terms), weight)
        yield from _emit(sums)

    return run


def _leaf_terms(terms: int):
    """(leaf, ids) to sums (leaf, term), sparse: a leaf has few of the terms.
    Term ``terms`` counts the documents."""
    width = terms + 1

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return [found], [np.bincount(inverse, np.concatenate(counts), len(found))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0)]
        for batch in batches:
            leaf = batch.column(0).to_numpy().astype(np.int64)
            rows, ids = _lists(batch.column(1))
            pairs = np.unique(rows.astype(np.int64) * terms + ids.to_numpy())
            found, n = np.unique(np.concatenate([leaf[pairs // terms] * width + pairs % terms, leaf * width + terms]), return_counts=True)
            keys.append(found)
            counts.append(n.astype(float))
            if len(keys) >= 20:
                keys, counts = summed(keys, counts)
        (key,), (count,) = summed(keys, counts)
        yield from pa.table({"i": pa.array(key // width, pa.int32()), "j": pa.array(key % width, pa.int32()), "w": count}).to_batches(max_chunksize=65_536)

    return run


class LeafTerms:
    """Documents of each leaf that have a term, sparse: entry k says that
    ``count[k]`` of leaf ``leaf[k]`` have ``term[k]``; ascending by leaf."""

    def __init__(self, leaf: np.ndarray, term: np.ndarray, count: np.ndarray, leaves: int, terms: int) -> None:
        order = np.lexsort((term, leaf))
        leaf, term, count = leaf[order], term[order], count[order]
        whole = term == terms
        self.sizes, self.leaves, self.terms = np.bincount(leaf[whole], count[whole], leaves), leaves, terms
        self.leaf, self.term, self.count = leaf[~whole], term[~whole], count[~whole]
        self.first = np.searchsorted(self.leaf, np.arange(leaves + 1))

    @classmethod
    def of(cls, rows: DataFrame, leaves: int, terms: int) -> LeafTerms:
        table = rows.groupBy("i", "j").agg(F.sum("w").alias("w")).toArrow()
        return cls(*(table[c].to_numpy() for c in "ijw"), leaves, terms)

    def own(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.first[leaf], self.first[leaf + 1])
        return self.term[at], self.count[at]

    def total(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """Documents that have each term, of all leaves or of those where ``chosen``."""
        keep = slice(None) if chosen is None else chosen[self.leaf]
        return np.bincount(self.term[keep], self.count[keep], self.terms)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _sentence_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Ascending key of the sentence of each term, the terms, and the keys that a document takes."""
    rows, ids = _lists(batch.column("ids"))
    at = pc.list_flatten(batch.column("at")).to_numpy()
    width = int(at.max(initial=0)) + 1
    return rows.astype(np.int64) * width + at, ids.to_numpy(), width


def _sentence_subjects(batch: pa.RecordBatch, evidence: np.ndarray, mixtures: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, row and subject of each sentence that has evidence."""
    keys, ids, width = _sentence_keys(batch)
    told = np.abs(evidence).max(axis=1) > 0
    keep = told[ids]
    keys, ids = keys[keep], ids[keep]
    first = _starts(keys)
    sentence = keys[first]
    owner = sentence // width
    if not len(first):
        return sentence, owner, owner
    score = np.add.reduceat(evidence[ids], first, axis=0)
    documents = _starts(owner)
    mixture = mixtures[batch.column("leaf").to_numpy()[owner[documents]]]
    many = np.diff(np.r_[documents, len(owner)])
    prior = mixture
    for _ in range(5):
        post = score + np.repeat(np.log(prior + 1e-3), many, axis=0)
        post = np.exp(post - post.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        prior = np.add.reduceat(post, documents, axis=0) + 0.5 * mixture
        prior /= prior.sum(axis=1, keepdims=True)
    return sentence, owner, (score + np.repeat(np.log(prior + 1e-3), many, axis=0)).argmax(axis=1)


def _recount(evidence: np.ndarray, mixtures: np.ndarray, family: np.ndarray, families: int):
    """Sums (subject, term) over sentences, then (family, subject)."""
    subjects, terms = evidence.shape[1], evidence.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term, by_family = np.zeros(subjects * terms), np.zeros(families * subjects)
        for batch in batches:
            sentence, owner, subject = _sentence_subjects(batch, evidence, mixtures)
            if not len(sentence):
                continue
            # All terms of a sentence with evidence count, so that terms without any so far can gain it.
            keys, ids, _ = _sentence_keys(batch)
            where = np.minimum(np.searchsorted(sentence, keys), len(sentence) - 1)
            hit = sentence[where] == keys
            by_term += np.bincount(subject[where[hit]] * terms + ids[hit], minlength=subjects * terms)
            by_family += np.bincount(family[batch.column("leaf").to_numpy()[owner]] * subjects + subject, minlength=families * subjects)
        yield from _emit(by_term.reshape(subjects, terms))
        yield from _emit(by_family.reshape(families, subjects), subjects)

    return run


def _assign(evidence: np.ndarray, mixtures: np.ndarray, names: list[str], share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, owner, subject = _sentence_subjects(batch, evidence, mixtures)
            counts = np.bincount(owner * len(names) + subject, minlength=batch.num_rows * len(names)).reshape(batch.num_rows, len(names))
            shares = counts / batch.column("sents").to_numpy()[:, None]
            row, s = np.nonzero(shares >= share)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array([names[k] for k in s], pa.string()), pa.array(shares[row, s])], ["doc_id", "subject", "share"]
            )

    return run


def _evidence(counts: np.ndarray, base: np.ndarray, least_gain: float = 0.2, least_g: float = 20.0, strength: float = 2.0) -> np.ndarray:
    """Log odds of subjects for each term: ``counts`` (subject, term) against
    the rates ``base`` (subject, term) that a term without evidence would
    have. Terms whose rates tell too little, or aren't certain to differ, have
    none (zeros)."""
    n = counts.sum(axis=0)
    odds = np.log((counts + strength * base) / ((n + strength) * base))
    p = (counts + 1e-9) / (n + 1e-9 * len(counts))
    gain = (p * np.log(p / base + 1e-12)).sum(axis=0)
    return (odds * ((gain >= least_gain) & (2 * n * gain >= least_g))).T


def leaf_families(leaf_terms: LeafTerms, block: int = 4096) -> np.ndarray:
    """Family of each leaf: leaves linked by a cosine of at least a half over
    their terms' document rates. Terms are taken ``block`` at a time."""
    x, n = leaf_terms, leaf_terms.leaves
    rate = x.count / x.sizes[x.leaf]
    norm = np.sqrt(np.bincount(x.leaf, rate**2, n))
    gram = np.zeros((n, n))
    for at in range(0, x.terms, block):
        keep = (x.term >= at) & (x.term < at + block)
        rates = np.zeros((n, block))
        rates[x.leaf[keep], x.term[keep] - at] = rate[keep]
        gram += rates @ rates.T
    near = gram >= 0.5 * np.outer(norm, norm) - 1e-12
    near &= np.outer(norm, norm) > 0
    near |= np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        following = np.array([label[near[i]].min() for i in range(n)])
        if np.array_equal(following, label):
            return np.unique(label, return_inverse=True)[1]
        label = following


def term_odds(leaf_terms: LeafTerms, family: np.ndarray, label_terms: np.ndarray, leaf_labels: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Log odds (subject, term) from the labelled documents, against the
    labels of the family that the term is at home in (has most documents in)."""
    odds, n = np.zeros(label_terms.shape), label_terms.sum(axis=0)
    everywhere = leaf_terms.total()
    for g in np.unique(family):
        own = family == g
        base = leaf_labels[own].sum(axis=0) + 1.0
        base /= base.sum()
        home = leaf_terms.total(own) > 0.5 * everywhere
        odds += home * np.log((label_terms + strength * base[:, None]) / ((n + strength) * base[:, None]))
    return odds


def label_leaves(leaf_terms: LeafTerms, family: np.ndarray, odds: np.ndarray, leaf_labels: np.ndarray, top: int = 40, sharpness: float = 4.0) -> np.ndarray:
    """Mixture of subjects (leaf, subject) of each leaf, from what its ``top``
    discriminative terms speak for and, with less weight, its labelled
    documents."""
    subjects, sizes = len(odds), leaf_terms.sizes
    mixtures = np.full((len(sizes), subjects), 1.0 / subjects)
    for g in np.unique(family):
        own = family == g
        base = leaf_labels[own].sum(axis=0) + 1.0
        base /= base.sum()
        rate_all = leaf_terms.total(own) / max(1.0, sizes[own].sum())
        for leaf in np.flatnonzero(own & (sizes > 0)):
            term, count = leaf_terms.own(leaf)
            rate = count / sizes[leaf]
            gain = rate * np.log((rate + 1e-9) / (rate_all[term] + 1e-9))
            best = np.argsort(-gain, kind="stable")[:top]
            weight = np.maximum(gain[best], 0.0)
            score = odds[:, term[best]] @ weight / max(weight.sum(), 1e-9)
            seen = leaf_labels[leaf]
            score = score + 0.25 * np.log((seen + 2.0 * base) / ((seen.sum() + 2.0) * base))
            m = np.exp(sharpness * (score - score.max()))
            mixtures[leaf] = m / m.sum()
    return mixtures


def terms_by_subject(leaf_terms: LeafTerms, mixtures: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Documents (subject, term): a leaf's documents with a term are shared out
    by the leaf's mixture and the term's own odds, since a leaf of two subjects
    has the terms of both."""
    out = np.zeros(odds.shape)
    for leaf, mixture in enumerate(mixtures):
        term, count = leaf_terms.own(leaf)
        share = (mixture + FLOOR)[:, None] * np.exp(odds[:, term])
        out[:, term] += count * share / share.sum(axis=0)
    return out


def _expected(leaf_terms: LeafTerms, family: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """(subject, term): the subjects' rates (family, subject) in the families
    that a term's documents are in."""
    share = rates / rates.sum(axis=1, keepdims=True)
    per = share[family[leaf_terms.leaf]] * leaf_terms.count[:, None]
    base = np.stack([np.bincount(leaf_terms.term, per[:, k], leaf_terms.terms) for k in range(rates.shape[1])])
    return base / np.maximum(leaf_terms.total(), 1e-9) + 1e-6


def described_terms(vocabulary: list[str], abouts: list[str], least: int = 4, share: float = 0.6) -> np.ndarray:
    """(subject, term): 1 where a term and a word of the subject's description
    begin alike, over at least ``least`` letters and ``share`` of the longer."""
    out = np.zeros((len(abouts), len(vocabulary)))
    by_start: dict[str, list[int]] = {}
    for i, term in enumerate(vocabulary):
        by_start.setdefault(term[:least], []).append(i)
    for k, about in enumerate(abouts):
        for word in {w for w in WORD.findall(about.lower()) if len(w) >= least}:
            for i in by_start.get(word[:least], []):
                alike = len(os.path.commonprefix([word, vocabulary[i]]))
                if alike >= share * max(len(word), len(vocabulary[i])):
                    out[k, i] = 1.0
    return out


def document_subjects(
    documents: DataFrame,
    labels: DataFrame,
    areas: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    share: float = 0.25,
    leaves: int = 384,
    min_share: float = 1 / 2000,
    max_share: float = 0.5,
    min_docs: int = 3,
    rounds: int = 2,
    iterations: int = 8,
    fit_documents: int | None = None,
    seed: int = 5,
) -> DataFrame:
    """``(doc_id, subject, share)``: for each document, the subjects of
    ``areas`` (as spelled there) to which at least ``share`` of the sentences
    of its main text belong.

    ``labels`` (doc_id, subject) are readers' labels of some documents; they
    may be wrong, incomplete or repeated, and are compared without white space
    at the ends and without case. A document without main text (null or empty
    text, menus, notices and error pages only) has no row. Rows are documents
    of their own, also where keys are null or repeat (labels belong to all
    rows of a key). Empty ``documents``, ``areas`` or ``labels`` give no row.
    Whole texts are read; other columns are not.

    The tree of leaves is fitted on all documents, unless ``fit_documents``
    asks for a sample: if there are more, a share drawn by a hash of their
    terms. Then only the tree's centres come from that sample: every document
    is put into a leaf, and the vocabulary, the leaves' and subjects' counts
    and the evidence are of all documents."""
    spark = documents.sparkSession
    plain = lambda c: F.lower(F.btrim(c.cast("string"), F.lit(" \t\r\n")))
    listed = areas.filter("subject is not null").groupBy("subject").agg(F.max("about").alias("about")) if "about" in areas.columns else areas.filter("subject is not null").select("subject", F.lit(None).alias("about")).distinct()
    names, abouts = zip(*sorted((r["subject"], r["about"] or "") for r in listed.collect())) if not listed.isEmpty() else ((), ())
    key_type = dict(documents.dtypes)[key_col]
    nothing = spark.createDataFrame([], f"doc_id {key_type}, subject string, share double")
    words = write_table(documents.select(F.col(f"`{key_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null").mapInArrow(word_batches, f"doc_id {key_type}, sents int, terms array<string>, at array<int>"), "words")
    n = words.count()
    counts = words.select("terms").mapInArrow(_term_counts, "term string, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))
    kept = counts.filter((F.col("docs") >= max(min_docs, min_share * n)) & (F.col("docs") <= max_share * n)).orderBy("term").toArrow()
    if not names or not kept.num_rows:
        drop(words)
        return nothing
    vocabulary, docs = kept["term"].to_pylist(), kept["docs"].to_numpy().astype(float)
    terms, subjects = len(vocabulary), len(names)
    coded = write_table(words.mapInArrow(_to_ids(vocabulary), f"doc_id {key_type}, sents int, ids array<int>, at array<int>"), "coded")
    drop(words)

    # Vectors and leaves.
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(terms)], inputCol="words", outputCol="counts")
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(np.log(n / docs)), inputCol="counts", outputCol="weighed")
    unit = Normalizer(inputCol="weighed", outputCol="features")
    vectorise = lambda rows: unit.transform(weigh.transform(vectors.transform(rows.withColumn("words", F.col("ids").cast("array<string>"))))).drop("words", "counts", "weighed")
    kmeans = BisectingKMeans(k=leaves, maxIter=iterations, seed=seed, minDivisibleClusterSize=MIN_LEAF, predictionCol="leaf")
    fitted, several = coded.filter(F.size("ids") > 0).select("ids"), n
    if fit_documents is not None:
        fitted, several = fitted.filter(F.pmod(F.xxhash64("ids", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(fit_documents / n * (1 << 20)))), min(n, fit_documents)
    # A task's sums are as large as the vocabulary for each cluster, so the documents are in few and equal parts, also where texts repeat. Their ids are shuffled, not their vectors.
    parts = max(-(-several // FIT_PART), min(-(-several // 5_000), spark.sparkContext.defaultParallelism))
    tree = kmeans.fit(vectorise(fitted.repartition(parts)).select("features"))
    found_leaves = len(tree.clusterCenters())
    assigned = write_table(tree.transform(vectorise(coded)).select("doc_id", "sents", "ids", "at", F.col("leaf").cast("int").alias("leaf")), "assigned")
    drop(coded)

    # Leaves' and labels' terms.
    sums = "i int, j int, w double"
    leaf_terms = LeafTerms.of(assigned.select("leaf", "ids").mapInArrow(_leaf_terms(terms), sums), found_leaves, terms)
    spelled = spark.createDataFrame([(s.strip().lower(), k) for k, s in enumerate(names)], "name string, number int")
    told = write_table(labels.select(F.col("doc_id").alias("labelled"), plain(F.col("subject")).alias("name")).join(F.broadcast(spelled), "name").groupBy("labelled").agg(F.collect_set("number").alias("numbers")), "told")
    few = told.count() <= BROADCAST_LABELS
    labelled = write_table(assigned.join(F.broadcast(told) if few else told, F.col("doc_id") == F.col("labelled")).select("numbers", "ids", "leaf"), "labelled")
    label_terms = _dense(labelled.select("numbers", "ids").mapInArrow(_group_terms(subjects, terms), sums), (subjects, terms + 1))
    label_terms, label_sizes = label_terms[:, :terms], label_terms[:, terms]
    leaf_labels = _dense(labelled.select(F.col("leaf").alias("i"), F.explode("numbers").alias("j"), (1.0 / F.size("numbers")).alias("w")), (found_leaves, subjects))
    drop(told, labelled)
    if not label_sizes.sum():
        return nothing
    family = leaf_families(leaf_terms)
    families = int(family.max()) + 1
    # The areas' own descriptions count like a document of the subject that has their words.
    odds = term_odds(leaf_terms, family, label_terms + described_terms(vocabulary, abouts), leaf_labels)
    mixtures = label_leaves(leaf_terms, family, odds, leaf_labels)

    # Evidence of terms, from the leaves, then from the sentences.
    floored = (mixtures + FLOOR) / (1 + FLOOR * subjects)  # as in the terms' counts, else rare subjects would seem to gain from every term
    rates = np.stack([leaf_terms.sizes[family == g] @ floored[family == g] for g in range(families)]) + 0.1
    evidence = _evidence(terms_by_subject(leaf_terms, mixtures, odds), _expected(leaf_terms, family, rates))
    for _ in range(rounds):
        again = _dense(assigned.mapInArrow(_recount(evidence, mixtures, family, families), sums), (subjects + families, max(terms, subjects)))
        evidence = _evidence(again[:subjects, :terms], _expected(leaf_terms, family, again[subjects:, :subjects] + 0.1))
    return assigned.mapInArrow(_assign(evidence, mixtures, list(names), share), f"doc_id {key_type}, subject string, share double")
