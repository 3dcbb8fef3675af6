"""The subpackage's queries: name to (session, folder of the tables) -> frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.llm.p1_groups import match_groups
from edgewise.llm.p2_frequent import frequent_items
from edgewise.llm.p4_topn import top_entries
from edgewise.llm.p5_terms import signed_rows, term_frequencies
from edgewise.llm.p6_pairs import pairs_together
from edgewise.llm.p7_pack import container_use, fill_containers
from edgewise.llm.p8_mix import mix_sources
from edgewise.llm.p9_subjects import document_subjects
from edgewise.sources import read_table
from edgewise.store import write_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups(read_table(spark, sf_dir, "edges"))


def p1_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("group_key").agg(F.count("*").alias("nodes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 200 items can hold 1/200 of the rows each, so the top 200 have them all."""
    top = frequent_items(read_table(spark, sf_dir, "transactions"), "item_id", k=200)
    return top.filter(F.col("n") * 200 >= F.col("total")).select(F.col("item").alias("item_id"))


def p2_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_items(read_table(spark, sf_dir, "transactions"), "item_id", k=100).select(F.col("item").alias("item_id"), F.col("n").alias("n_rows"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_entries(read_table(spark, sf_dir, "association_rules"), n=5).select("item", "place", "consequent")


def p4_best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_entries(read_table(spark, sf_dir, "association_rules"), n=10)


def _late() -> Column:
    """Rows that came more than a day after they were recorded."""
    return F.coalesce(F.col("ingested_at") > F.col("recorded_at") + F.expr("interval 1 day"), F.lit(False))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows: those that came in time, then the late ones as a change."""
    rows = read_table(spark, sf_dir, "transactions")
    marks = term_frequencies(rows.filter(~_late()), rows.filter(_late())).marks()
    return marks.filter("mark is not null").select(F.col("term").alias("item_id"), "mark")


def p5_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts after three changes: the rows that came within a day, the
    late rows, and the removal of all rows with a negative frequency."""
    rows = read_table(spark, sf_dir, "transactions")
    counts = term_frequencies(rows.filter(~_late()), rows.filter(_late()))
    counts.apply(signed_rows(rows.filter("frequency < 0"), -1))
    return counts.marks().select(F.col("term").alias("item_id"), "n_rows", F.col("n_records").alias("n_baskets"), "mark")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_together(read_table(spark, sf_dir, "transactions")).select("item_a", "item_b")


def p6_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_together(read_table(spark, sf_dir, "transactions"), min_common=8, min_lift=2).select("item_a", "item_b", "common", F.round("lift", 6).alias("lift"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = fill_containers(read_table(spark, sf_dir, "documents"))
    return packed.filter("piece = 0 and pieces > 1").select(F.col("key").alias("doc_id"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = fill_containers(read_table(spark, sf_dir, "documents"))
    return packed.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"))


def p7_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_use(fill_containers(read_table(spark, sf_dir, "documents")))


def p7_use_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all tokens are in containers, none holds too much, and their
    number is at most one and one in a hundred above the least possible."""
    packed = fill_containers(read_table(spark, sf_dir, "documents"))
    each = packed.groupBy("container").agg(F.sum("length").alias("used"))
    facts = each.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("most"))
    least = F.ceil(F.col("tokens") / 8192)
    return facts.select("tokens", (F.col("most") <= 8192).alias("none_overfull"), (F.col("containers") <= 1 + least * 1.01).alias("nearly_least"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))
    return mix.report.filter("short").select("source")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets")).report


def p8_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets")).rows


def p8_report_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: whether its copies are the expected number to within
    one and no more than allowed, and whether the shares add up."""
    report = p8_report(spark, sf_dir)
    expected = F.least(F.col("max_repeats").cast("double"), F.try_divide("wanted", F.col("size").cast("double"))) * F.col("documents")
    shares = report.agg((F.abs(F.sum("reached_share") - 1) < 1e-9).alias("shares_hold"))
    kept = report.select("source", "documents", "size", "short", (F.abs(F.col("copies") - F.coalesce(expected, F.lit(0.0))) <= 1 + 1e-6).alias("copies_hold"), (F.col("copies") <= F.col("documents") * F.col("max_repeats")).alias("cap_holds"))
    return kept.crossJoin(F.broadcast(shares))  # one row


def p8_rows_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: whether its rows are those of the report, none oftener
    than allowed, numbered from 1, and of sources that fall short all of them
    as often as allowed."""
    mix = mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))
    each = mix.rows.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"), F.sum("size").alias("tokens"))
    drawn = each.groupBy("source").agg(F.count("*").alias("drawn"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.min("n").alias("least"), F.max("last").alias("last"), F.sum("tokens").alias("tokens"))
    met = mix.report.join(drawn, "source", "left").na.fill(0)
    all_used = ~F.col("short") | (F.col("documents") == 0) | ((F.col("drawn") == F.col("documents")) & (F.col("least") == F.col("max_repeats")))
    return met.select("source", ((F.col("rows") == F.col("copies")) & (F.col("tokens") == F.col("reached"))).alias("report_holds"), ((F.col("most") <= F.col("max_repeats")) & (F.col("last") == F.col("most"))).alias("cap_holds"), all_used.alias("all_used"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "subject_labels"), read_table(spark, sf_dir, "subject_areas"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p9_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents of each subject, and their mean share."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.avg("share").alias("mean_share"))


def p9_makeup_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each subject: whether its shares are a quarter to the whole of a
    document, no document has it twice, and none has more than four subjects;
    and of the readers' labels, whether at least half are found (fewer than 30
    labels tell nothing)."""
    found = write_table(_subjects(spark, sf_dir), "subjects")
    labels = read_table(spark, sf_dir, "subject_labels").select("doc_id", F.lower(F.btrim("subject")).alias("label")).distinct()
    agreed = found.select("doc_id", F.lower("subject").alias("label")).distinct().withColumn("hit", F.lit(1))
    half = labels.join(agreed, ["doc_id", "label"], "left").agg(((F.count("hit") * 2 >= F.count("*")) | (F.count("*") < 30)).alias("half_of_labels"))
    many = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("share").alias("sum")).agg((F.coalesce(F.max("n"), F.lit(0)) <= 4).alias("four_at_most"), (F.coalesce(F.max("sum"), F.lit(0)) <= 1 + 1e-9).alias("whole_at_most"))
    each = found.groupBy("subject").agg(F.min("share").alias("least"), F.count("*").alias("rows"), F.countDistinct("doc_id").alias("documents"))
    areas = read_table(spark, sf_dir, "subject_areas").select("subject").join(each, "subject", "left")
    kept = areas.select("subject", (F.coalesce("least", F.lit(1.0)) >= 0.25).alias("quarter_at_least"), F.coalesce(F.col("rows") == F.col("documents"), F.lit(True)).alias("once"))
    return kept.crossJoin(F.broadcast(half)).crossJoin(F.broadcast(many))  # one row each


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_group_sizes, p2_found, p2_top_items, p4_found, p4_best_scores, p5_found, p5_late_rows, p6_found, p6_lift, p7_found, p7_pieces, p7_use, p7_use_holds, p8_found, p8_report, p8_report_holds, p8_rows, p8_rows_hold, p9_found, p9_makeup, p9_makeup_holds)
}
