"""How well approximate pairs agree with exact ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["id1", "id2"]


def common_pairs(one: DataFrame, other: DataFrame) -> DataFrame:
    """The pairs in both tables."""
    return one.select(*KEYS).intersect(other.select(*KEYS))


def copy_weights(texts: DataFrame, k: int = 10) -> DataFrame:
    """``(id, copies)`` of the texts long enough to be in a pair."""
    return texts.where(F.length("text") >= k).select("id", "copies")


def pair_quality(exact: DataFrame, approx: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: sizes, intersection, recall and precision, counted in pairs of documents.

    Both inputs are pairs of distinct texts; ``weights`` gives each text's copies. A pair of texts
    stands for ``copies1 * copies2`` document pairs, and the copies of one text, equal and hence in
    both results, for ``copies * (copies - 1) / 2``. So all pairs are counted and none is listed
    more than once. Recall of nothing is NULL.
    """
    exact = exact.select(*KEYS, F.lit(True).alias("in_exact"))
    approx = approx.select(*KEYS, F.lit(True).alias("in_approx"))
    both = exact.join(approx, KEYS, "full")
    first = weights.select(F.col("id").alias("id1"), F.col("copies").alias("c1"))
    second = weights.select(F.col("id").alias("id2"), F.col("copies").alias("c2"))
    between = both.join(first, "id1").join(second, "id2").select(
        (F.col("c1") * F.col("c2")).alias("w"),
        F.coalesce("in_exact", F.lit(False)).alias("in_exact"),
        F.coalesce("in_approx", F.lit(False)).alias("in_approx"),
    )
    within = weights.where(F.col("copies") > 1).select(
        F.expr("copies * (copies - 1) div 2").alias("w"),
        F.lit(True).alias("in_exact"),
        F.lit(True).alias("in_approx"),
    )

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("w"))), F.lit(0)).cast("bigint")

    counted = between.unionByName(within).agg(
        total(F.col("in_exact")).alias("exact_pairs"),
        total(F.col("in_approx")).alias("approx_pairs"),
        total(F.col("in_exact") & F.col("in_approx")).alias("common_pairs"),
    )
    share = lambda of: F.try_divide(F.col("common_pairs").cast("double"), F.col(of))
    return counted.select(
        "*", share("exact_pairs").alias("recall"), share("approx_pairs").alias("precision")
    )


def partners(pairs: DataFrame, links: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, partner)``: every document similar to the documents asked for in ``ids``.

    Resolves pairs of distinct texts and the copies linked to them (``copy_links``) to documents,
    for the ids asked for only: one row per partner of an asked document.
    """
    asked = ids.select(F.col("id").alias("doc")).distinct()
    text_of = asked.join(links.select(F.col("copy_id").alias("doc"), "id"), "doc", "left").select(
        "doc", F.coalesce("id", "doc").alias("text_id")
    )
    both_ways = F.array(
        F.struct(F.col("id1").alias("text_id"), F.col("id2").alias("other")),
        F.struct(F.col("id2").alias("text_id"), F.col("id1").alias("other")),
    )
    similar = text_of.join(pairs.select(F.inline(both_ways)), "text_id").select("doc", "other")
    texts = similar.unionByName(text_of.select("doc", F.col("text_id").alias("other")))
    copies = texts.join(links.select(F.col("id").alias("other"), "copy_id"), "other")
    found = texts.select("doc", F.col("other").alias("partner")).unionByName(
        copies.select("doc", F.col("copy_id").alias("partner"))
    )
    return found.where(F.col("doc") != F.col("partner")).select(F.col("doc").alias("id"), "partner")
