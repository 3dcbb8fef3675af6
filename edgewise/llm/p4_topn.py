"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions import clean_value


def top_entries(
    rules: DataFrame, n: int = 5, item_col: str = "item", entries_col: str = "consequents", scores_col: str = "confidence_scores"
) -> DataFrame:
    """``(item, place, consequent, score)``: for each item, the ``n`` entries
    with the highest scores, over all of its rows; ties go to the entry that
    comes first by bytes.

    The score at a position belongs to the entry at the same position. An
    entry whose item, entry or score is missing (null, empty, ``N/A``), null
    or NaN, or whose position the other list doesn't have, doesn't count.
    Null and empty lists give nothing. The same entry again counts once, with
    its highest score. Items with fewer entries give fewer rows; an empty
    table gives none. Other columns are not read.

    The repeated entries are merged first, under the key (item, entry), which
    spreads a hot item over all tasks; the rank filter is then a group limit
    before the shuffle by item (at most ``n`` rows for each item leave a task)
    and again after it."""
    pairs = F.explode(F.arrays_zip(F.col(f"`{entries_col}`").alias("e"), F.col(f"`{scores_col}`").cast("array<double>").alias("s")))
    entries = (
        rules.select(clean_value(F.col(f"`{item_col}`")).alias("item"), pairs.alias("x"))
        .select("item", clean_value(F.col("x.e")).alias("consequent"), F.col("x.s").alias("score"))
        .filter(F.col("item").isNotNull() & F.col("consequent").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    )
    best = entries.groupBy("item", "consequent").agg(F.max("score").alias("score"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "consequent")))
    return ranked.filter(F.col("place") <= n).select("item", F.col("place").cast("bigint").alias("place"), "consequent", "score")
