"""Rates of events on the first rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their number ``rn``.

    Tasks keep ``n`` rows per group before the shuffle, so a large group costs no more than others.
    """
    numbered = df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered.where(F.col("rn") <= n)


def rate_of(samples: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row: the number of samples and the share that satisfies each predicate."""
    rates = [F.avg(p.cast("double")).alias(name) for name, p in predicates.items()]
    return samples.agg(F.count(F.lit(1)).alias("samples"), *rates)


def prefix_rates(df: DataFrame, group: str, order: list[str], key: str, wanted: str, uniform: str) -> DataFrame:
    """Shares of groups whose first rows show a pattern.

    ``wanted`` among the first two, or five; the first two alike; the first five all ``uniform``; the
    first five made of three of one key and two of another.
    """
    first = first_rows(df, group, order, 5)
    per_key = first.groupBy(group, F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(F.col("rn") <= 2).alias("_c2")
    )
    wanted_row = F.col("_key") == F.lit(wanted)
    samples = per_key.groupBy(group).agg(
        F.coalesce(F.sum(F.when(wanted_row, F.col("_c2"))), F.lit(0)).alias("w2"),
        F.coalesce(F.sum(F.when(wanted_row, F.col("_c"))), F.lit(0)).alias("w5"),
        F.max("_c2").alias("same2"),
        F.coalesce(F.sum(F.when(F.col("_key") == F.lit(uniform), F.col("_c"))), F.lit(0)).alias("u5"),
        F.max("_c").alias("most"),
        F.min("_c").alias("least"),
        F.count(F.lit(1)).alias("kinds"),
    )
    return rate_of(
        samples,
        {
            "wanted_in_two": F.col("w2") > 0,
            "wanted_in_five": F.col("w5") > 0,
            "first_two_alike": F.col("same2") == 2,
            "five_uniform": F.col("u5") == 5,
            "three_and_two": (F.col("kinds") == 2) & (F.col("most") == 3) & (F.col("least") == 2),
        },
    )
