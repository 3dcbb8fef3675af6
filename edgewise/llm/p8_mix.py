"""Mixing sources to target weights, by systematic sampling.

Every document of a source has the same expected number of copies: the size
wanted from the source over the size it has, at most its cap. The documents'
expected copies are summed up along the source, one random offset is added,
and a document is emitted once for each whole number that its stretch of the
sum crosses. So a source gives the wanted number of copies to within one, no
document is emitted more often than the cap, and the copies of documents of
every size (the sum runs along the sizes within a bucket) are near their
expectation.

The prefix sums are exact (the rate is a fraction of whole numbers, and a row's
number times it is divided as a whole number) and never run over a whole
source: documents are put into buckets of a source by a hash, numbered within
their bucket, and shifted by the counts of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions import clean_source
from edgewise.llm.sizes import byte_tokens
from edgewise.store import drop, write_table

#: Parts of a token in which a source's wanted size is counted.
UNIT = 1 << 20
#: Rows of mix_targets that are broadcast if there are counted to be no more.
BROADCAST_TARGETS = 100_000


class Mix:
    """``rows``: (doc_id, source, size, copy), one for each emitted copy;
    ``report``: one row for each source of the targets."""

    def __init__(self, rows: DataFrame, report: DataFrame) -> None:
        self.rows, self.report = rows, report


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    size: Column | None = None,
    key_col: str = "doc_id",
    total: int | str | None = None,
    seed: int = 11,
    bucket_rows: int = 250_000,
) -> Mix:
    """Draws documents so that each source has its ``target_share`` of
    ``total`` tokens (by default the size of all documents, each once, of all
    sources in ``targets``), with at most ``max_repeats`` copies of each.

    Sources that fall short of their share of the total leave the others with
    more than theirs of what is drawn. With ``total="reachable"`` it is the
    largest total of which every source that has documents can give its share.

    ``size``: of a document, by default the byte tokens of ``text``; documents
    without a size (null text) are not drawn, nor are those whose source is
    null, empty or not in ``targets``. Sources are compared without white
    space at both ends and in lower case; rows of ``targets`` that name the
    same source are one target (shares add up, the largest cap holds); a null
    share is 0 and a null cap 1. Documents with null or repeated keys are
    drawn like others; other columns are not read. No document or no target
    gives an empty draw; each target still has its row in the report.

    The report has ``source, target_share, max_repeats, documents, size,
    wanted, copies, reached, reached_share, short``: ``size`` is that of the
    source's documents, each once, ``wanted`` the share of the total,
    ``reached`` and ``reached_share`` what was drawn, and ``short`` is true if
    even ``max_repeats`` copies of everything are less than ``wanted``."""
    spark = documents.sparkSession
    wish = write_table(
        targets.select(clean_source("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap")).filter("source is not null")
        .groupBy("source").agg(F.sum(F.coalesce("share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("cap", F.lit(1))).alias("max_repeats")),
        "targets",
    )
    few = wish.count() <= BROADCAST_TARGETS
    bounded = lambda frame: F.broadcast(frame) if few else frame
    sized = documents.select(F.col(f"`{key_col}`").alias("doc_id"), clean_source("source").alias("source"), (size if size is not None else byte_tokens("text")).cast("bigint").alias("size")).filter("source is not null and size is not null")
    sized = write_table(sized.join(bounded(wish.select("source")), "source", "left_semi"), "sized")
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("size"))
    facts = sized.agg(F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    if total == "reachable":
        most = wish.filter("target_share > 0").join(have.filter("size > 0"), "source").select(F.min(F.col("max_repeats") * F.col("size") / F.col("target_share")).alias("most")).first()["most"]
        total = max(0, int(most or 0))
    whole = facts["size"] if total is None else total
    buckets = max(1, -(-facts["documents"] // bucket_rows))
    plan = write_table(
        wish.join(have, "source", "left").select(
            "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
            (F.col("target_share") * F.lit(float(whole))).alias("wanted"),
        ).withColumn("most", _exact(F.greatest("max_repeats", F.lit(0)), 10) * _exact(F.col("size"), 19) * F.lit(UNIT))
        .withColumn("rate", _exact(F.when(F.col("wanted") >= F.col("max_repeats") * F.col("size").cast("double"), F.col("most")).otherwise(F.least("most", _exact(F.greatest(F.lit(0.0), "wanted") * UNIT, 38))), 22)),
        "plan",
    )
    placed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    # At most ``buckets`` rows for each source.
    before = counts.select("source", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = placed.withColumn("row", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("size", F.xxhash64("doc_id", F.lit(seed)), "doc_id")))
    place = local.join(before, ["source", "bucket"]).join(bounded(plan.select("source", "rate", _exact(F.greatest("size", F.lit(1)), 19).alias("available"))), "source")
    offset = _exact(F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(UNIT)), 7) * F.col("available")
    position = F.col("before") + F.col("row")
    crossed = lambda row: F.call_function("div", _exact(row, 15) * F.col("rate") + offset, F.col("available") * F.lit(UNIT))
    # Written, with the report, so that the draw runs once, and also where only columns of the plan are asked for.
    copies = write_table(place.select("doc_id", "source", "size", crossed(position).alias("hi"), crossed(position - 1).alias("lo")).filter("hi > lo"), "copies")
    rows = copies.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("hi") - F.col("lo"))).alias("copy"))
    drawn = copies.groupBy("source").agg(F.sum(F.col("hi") - F.col("lo")).alias("copies"), F.sum((F.col("hi") - F.col("lo")) * F.col("size")).alias("reached"))
    drawn = drawn.withColumn("all", F.sum("reached").over(Window.partitionBy(F.lit(1))))  # one row for each source
    report = write_table(plan.join(bounded(drawn), "source", "left").select(
        "source", "target_share", "max_repeats", "documents", "size", "wanted", F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"), F.coalesce("reached", F.lit(0)).cast("bigint").alias("reached"),
        F.coalesce(F.try_divide(F.col("reached").cast("double"), F.col("all").cast("double")), F.lit(0.0)).alias("reached_share"),
        (F.col("size") * F.col("max_repeats") < F.col("wanted")).alias("short"),
    ), "report")
    drop(wish, sized, plan)
    return Mix(rows, report)


def _exact(number: Column, digits: int) -> Column:
    """A whole number of at most so many digits, for products beyond 64 bits."""
    return number.cast(f"decimal({digits},0)")
