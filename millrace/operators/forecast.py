"""Forecast features, pairs and errors on sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vectors


def normalised(windows: DataFrame, features: list[str], base: str) -> DataFrame:
    """Add ``n_<feature>`` relative to each feature's first value, ``base`` and ``n_y``.

    The target is relative to the window's first value of the feature ``base``.
    """
    out = {f"n_{f}": vectors.relative(F.col(f"x_{f}")) for f in features}
    first = F.get(F.col(f"x_{base}"), F.lit(0))
    out["base"] = first
    if "y" in windows.columns:
        out["n_y"] = vectors.relative(F.col("y"), first)
    return windows.withColumns(out)


def split_windows(windows: DataFrame, series: list[str], ratio: float = 0.7) -> DataFrame:
    """Add ``part`` and ``part_window``, a window's number within its part.

    The cut is ``floor(w * ratio)`` of a series' w windows. Windows of a numbered frame bring w along;
    for others it is one more than the last window's number, and one row per series tells it.
    """
    if "n_windows" not in windows.columns:
        totals = windows.groupBy(*series).agg((F.max("window") + 1).alias("n_windows"))
        windows = windows.join(totals, series)
    joined = windows.withColumn("_cut", F.floor(F.col("n_windows") * F.lit(ratio)))
    test = F.col("window") >= F.col("_cut")
    return joined.withColumns(
        {
            "part": F.when(test, "test").otherwise("train"),
            "part_window": F.when(test, F.col("window") - F.col("_cut")).otherwise(F.col("window")),
        }
    ).drop("n_windows", "_cut")


def forecast_pairs(windows: DataFrame, series: list[str], prediction: Column, n_out: int) -> DataFrame:
    """``(series..., part, step, pred, true)``: every ``n_out``-th window of a part, flattened.

    ``prediction`` is the window's array of normalised predictions, from any model.
    """
    chosen = windows.where(F.col("part_window") % n_out == 0)
    rows = F.arrays_zip(
        F.col("steps").alias("step"),
        vectors.absolute(prediction, F.col("base")).alias("pred"),
        F.col("y").alias("true"),
    )
    return chosen.select(*series, "part", F.inline(rows))


def persistence(feature: str, n_out: int) -> Column:
    """The normalised forecast that repeats the last seen value of ``feature``."""
    return F.array_repeat(F.element_at(F.col(f"n_{feature}"), -1), n_out)


def mean_absolute_error(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., n, mae)`` of ``pred`` against ``true``."""
    error = F.abs(F.col("pred") - F.col("true"))
    return pairs.groupBy(*by).agg(F.count(error).alias("n"), F.avg(error).alias("mae"))


def lag_pairs(windows: DataFrame, series: list[str], feature: str, lag: int) -> DataFrame:
    """Each window's first target against the value ``lag`` rows before it."""
    return windows.select(
        *series,
        "part",
        F.element_at(F.col(f"x_{feature}"), -lag).alias("pred"),
        F.get("y", F.lit(0)).alias("true"),
    )
