"""Open/high/low/close bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tick_bars(
    df: DataFrame, series: list[str], ts: str, tie: str, unit: str, price: str, volume: str
) -> DataFrame:
    """Bars of single rows: per series and truncated timestamp, first and last price by (ts, tie)."""
    order = F.struct(ts, tie)
    bucket = F.date_trunc(unit, F.col(ts))
    return df.groupBy(*series, bucket.alias("ts")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"),
    )


def high_close_mean() -> Column:
    """The default daily mean, ``(high + close) / 2``."""
    return (F.col("high") + F.col("close")) / 2


def daily_bars(
    bars: DataFrame, series: list[str], ts: str = "ts", mean: Callable[[], Column] = high_close_mean
) -> DataFrame:
    """Daily bars from finer ones; open and close keep a NULL that stands first or last.

    Only fixed-width values are aggregated, ordered by a timestamp that is unique in a series, so
    the bars combine in hash tables before the shuffle.
    """
    daily = bars.groupBy(*series, F.to_date(ts).alias("day")).agg(
        F.min_by("open", ts).alias("open"),
        F.max_by("close", ts).alias("close"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("volume").alias("volume"),
    )
    return daily.withColumn("mean", mean())
