"""Association scores between the items of transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.model import Scopes, transaction_rows
from edgewise.operators.components import number_rows
from edgewise.store import drop, write_table

#: Entries that a rule lists.
LISTED = 5


def reaching_minimum(items: DataFrame, links: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """``(id, root)``: for each ``id`` of ``items``, the smallest id that
    reaches it over the directed ``links`` (``src``, ``dst``), itself
    included. Each round passes labels along the links and then to the label
    of the label, so long chains take few rounds."""
    labels = write_table(items.select("id", F.col("id").alias("root")), "labels")
    for _ in range(max_rounds):
        passed = labels.join(links, labels["id"] == links["src"]).groupBy("dst").agg(F.min("root").alias("passed")).withColumnRenamed("dst", "id")
        nearer = labels.join(passed, "id", "left").select("id", "root", F.least("root", F.coalesce("passed", "root")).alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("root").alias("far"))
        following = write_table(nearer.join(jump, "near").select("id", F.least("near", "far").alias("root"), F.col("root").alias("before")), "labels")
        drop(labels)
        labels = following
        if labels.filter("root <> before").isEmpty():
            break
    return labels.select("id", "root")


def graph_association_rules(
    df: DataFrame,
    transaction_id: str | Column,
    item_id: str | Column,
    frequency: str | Column | None = None,
    min_support: float = 0.01,
    min_confidence: float = 0.1,
    max_itemset_size: int = 50,
    weighted: bool = False,
    order_by: str | Column | Sequence[str | Column] | None = None,
    partition_by: Sequence[str | Column] = (),
) -> DataFrame:
    """``(item, support, lift_score, pattern, consequents, confidence_scores)``:
    one row for each item that is frequent enough.

    * A row takes part if its transaction (as a 64-bit integer), item (as a
      string) and frequency (as a double; 1 without the column) are all given.
      ``N`` is the number of transactions with such a row.
    * ``support`` is the item's number of rows, or the sum of its frequencies
      if ``weighted``; repeated rows count. Items with support / N of at least
      ``min_support`` and a positive support are valid; a NaN sum is not.
    * Transactions of more than ``max_itemset_size`` rows give no entries, but
      count for support and N.
    * Each ordered pair of rows of a transaction with different, valid items
      is an entry of the first item, with the confidence f_a * f_c / support_a
      if weighted, else rows_a / N. Entries below ``min_confidence`` (or NaN)
      fall away; they are not merged.
    * ``lift_score`` is the sum of an item's confidences.
    * ``pattern`` numbers the roots of the items: an item's root is the first
      item from which entries lead to it, directly or through others.
    * ``consequents`` and ``confidence_scores`` list the first five entries,
      by confidence (highest first), then by consequent; both are empty for an
      item without entries.

    "First" means first appearance in the order of ``order_by``, or the
    smallest item where that isn't given. An empty table gives no row.

    Columns may be names or expressions. With ``partition_by``, each
    combination of its values is a set of transactions of its own, with its
    own N and numbers, and the values come first in the result.

    Oversized transactions are removed before the self-join, so a row meets at
    most ``max_itemset_size`` others. Equal rows of a transaction are one row
    with their number, a pair of items meets once for both directions, and
    equal products are combined before the first shuffle after the join."""
    scopes = Scopes(df, partition_by)
    g = ["g"] if partition_by else []
    rows = write_table(transaction_rows(df, transaction_id, item_id, frequency, order_by, *(scopes.of(scopes.inside(F.lit(""))).alias(k) for k in g)), "rules-rows")
    order = [c for c in rows.columns if c.startswith("o")]
    sizes = write_table(rows.groupBy(*g, "t").agg(F.count("*").alias("size")), "rules-sizes")
    first = F.min(F.struct(*order)) if order else F.min("item")
    per_item = rows.groupBy(*g, "item").agg(F.count("*").cast("double").alias("cnt"), F.sum("f").alias("total"), first.alias("first"))
    if g:
        per_item = per_item.join(sizes.groupBy("g").agg(F.count("*").cast("double").alias("n")), "g")
    else:
        per_item = per_item.withColumn("n", F.lit(float(sizes.count())))
    valid = per_item.withColumn("support", F.col("total") if weighted else F.col("cnt")).filter(~F.isnan("support") & (F.col("support") > 0) & (F.col("support") / F.col("n") >= F.lit(float(min_support))))
    # Numbers ascend by first appearance, of all graphs together.
    items = write_table(number_rows(valid.select(*g, "item", "support", "cnt", "n", "first"), [], "first", "id").drop("first"), "rules-items")
    eligible = rows.join(sizes.filter(F.col("size") <= max_itemset_size).select(*g, "t"), [*g, "t"]).join(items.select(*g, "item", "id"), [*g, "item"])
    value = F.col("f") if weighted else F.lit(1.0)
    eligible = write_table(eligible.groupBy(*g, "t", "id", value.alias("f")).agg(F.count("*").alias("m")), "rules-eligible")
    drop(rows, sizes)
    other = eligible.select(*g, "t", F.col("id").alias("c_id"), F.col("f").alias("c_f"), F.col("m").alias("c_m"))
    met = eligible.join(other, [*g, "t"]).filter("id < c_id").select("id", "c_id", (F.col("f") * F.col("c_f")).alias("product"), (F.col("m") * F.col("c_m")).alias("times"))
    pairs = met.filter(~F.isnan("product")).groupBy("id", "c_id", "product").agg(F.sum("times").alias("times"))
    ways = F.array(F.struct("id", "c_id"), F.struct(F.col("c_id").alias("id"), F.col("id").alias("c_id")))
    both = pairs.select(F.explode(ways).alias("x"), "product", "times").select("x.*", "product", "times")
    confidence = F.col("product") / F.col("support") if weighted else F.col("cnt") / F.col("n")
    scored = both.join(items.select("id", "support", "cnt", "n"), "id").select("id", "c_id", confidence.alias("confidence"), "times").filter(~F.isnan("confidence") & (F.col("confidence") >= F.lit(float(min_confidence))))
    entries = write_table(scored.join(items.select(F.col("id").alias("c_id"), F.col("item").alias("consequent")), "c_id"), "rules-entries")
    drop(eligible)
    lift = entries.groupBy("id").agg(F.sum(F.col("confidence") * F.col("times")).alias("lift_score"))
    links = write_table(entries.select(F.col("id").alias("src"), F.col("c_id").alias("dst")).distinct(), "rules-links")
    roots = reaching_minimum(items, links)
    drop(links)
    patterns = number_rows(roots.join(items.select("id", *g), "id").select(*g, "root").distinct(), g, "root", "pattern").drop(*g)
    ranked = entries.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "consequent"))).filter(F.col("rank") <= LISTED)
    # Five different entries are at least five entries; each is listed as often as it occurs.
    repeated = F.array_repeat(F.struct("rank", "consequent", "confidence"), F.least("times", F.lit(LISTED)).cast("int"))
    lists = ranked.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(repeated))), 1, LISTED).alias("top"))
    none = F.array().cast("array<struct<rank:int,consequent:string,confidence:double>>")
    out = items.join(roots, "id").join(patterns, "root").join(lift, "id", "left").join(lists, "id", "left").withColumn("top", F.coalesce("top", none))
    return scopes.named_rows(
        out, F.col("g") if g else F.lit(""),
        F.col("item"), F.col("support"), F.coalesce("lift_score", F.lit(0.0)).alias("lift_score"), F.col("pattern"),
        F.col("top.consequent").alias("consequents"), F.col("top.confidence").alias("confidence_scores"),
    )
