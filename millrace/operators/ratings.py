"""Top-k reports over (item, rating) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_by_count(ratings: DataFrame, item: str = "item", k: int = 10) -> DataFrame:
    """The ``k`` most rated items; at equal counts the larger name comes first.

    Counts combine before the shuffle and the limit is a per-task top-k merge, not a global sort.
    """
    counts = ratings.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.desc("item")).limit(k)


def top_by_mean(
    ratings: DataFrame,
    item: str = "item",
    rating: str = "rating",
    min_count: int = 100,
    k: int = 10,
) -> DataFrame:
    """The ``k`` items of highest mean rating among those with at least ``min_count`` ratings."""
    means = ratings.groupBy(F.col(item).alias("item")).agg(
        F.avg(rating).alias("mean_rating"), F.count(F.lit(1)).alias("n")
    )
    eligible = means.where(F.col("n") >= min_count)
    return eligible.orderBy(F.desc("mean_rating"), F.desc("item")).limit(k)
