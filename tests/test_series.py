from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import bars, fills, forecast, ordered, prefixes

START = dt.datetime(2024, 1, 1)


def minute(i):
    return START + dt.timedelta(minutes=i)


@pytest.fixture(scope="module")
def gappy():
    draw = random.Random(3)
    return [(s, i, draw.choice([None, None, float(draw.randrange(100))])) for s in "ab" for i in range(40)]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_forward_fill_equals_pandas_whatever_the_blocks(spark, gappy, size):
    df = spark.createDataFrame(gappy, "s string, i int, v double")
    got = fills.forward_fill(df, ["s"], ["i"], F.floor(F.col("i") / size), ["v"]).orderBy("s", "i").toPandas()
    expected = pd.DataFrame(gappy, columns=["s", "i", "v"]).groupby("s")["v"].ffill()
    np.testing.assert_array_equal(got["v"].to_numpy(), expected.to_numpy(dtype=float))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_interpolate_equals_pandas_whatever_the_blocks(spark, gappy, size):
    df = spark.createDataFrame(gappy, "s string, i int, v double")
    got = fills.interpolate(df, ["s"], "i", ["v"], size).orderBy("s", "i").toPandas()
    pdf = pd.DataFrame(gappy, columns=["s", "i", "v"]).astype({"v": float})
    expected = pdf.groupby("s")["v"].transform(lambda v: v.interpolate())
    np.testing.assert_allclose(got["v"].to_numpy(), expected.to_numpy())


@pytest.mark.parametrize("block_ticks", [2, 100])
def test_grid_leaves_out_the_last_tick_and_rows_off_it(spark, block_ticks):
    rows = [("a", minute(0), 1.0), ("a", minute(2) + dt.timedelta(seconds=7), 9.0), ("a", minute(3), 2.0),
            ("a", minute(5), 3.0), ("b", minute(1), 4.0)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, v double")
    got = {(r.s, r.tick): r.v for r in fills.grid_fill(df, ["s"], "ts", 60, block_ticks=block_ticks).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): None, ("a", 2): None, ("a", 3): 2.0, ("a", 4): None}
    closed = fills.grid_fill(df, ["s"], "ts", 60, closed=True, block_ticks=block_ticks)
    assert {(r.s, r.tick) for r in closed.collect()} == {("a", i) for i in range(6)} | {("b", 0)}


def test_daily_bars_keep_null_ends(spark):
    rows = [("a", minute(0), None, 1.0, 5.0, 2.0, 1.0), ("a", minute(1), 3.0, 2.0, 6.0, 4.0, 2.0),
            ("a", minute(1440), 7.0, 7.0, 7.0, None, 4.0)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, open double, low double, high double, close double, volume double")
    got = {str(r.day): (r.open, r.close, r.low, r.high, r.volume, r["mean"]) for r in bars.daily_bars(df, ["s"]).collect()}
    assert got == {"2024-01-01": (None, 4.0, 1.0, 6.0, 3.0, 5.0), "2024-01-02": (7.0, None, 7.0, 7.0, 4.0, None)}
    low_high = bars.daily_bars(df, ["s"], mean=lambda: (F.col("low") + F.col("high")) / 2)
    assert {r["mean"] for r in low_high.collect()} == {3.5, 7.0}


@pytest.mark.parametrize("size", [1, 4, 100])
def test_numbering_totals_and_shards(spark, size):
    rows = [(s, x) for s, n in (("a", 11), ("b", 3)) for x in range(n)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "s string, x int")
    numbered = ordered.number_rows(df, ["s"], ["x"], F.floor(F.col("x") / size))
    assert all(r.pos == r.x and r.series_rows == {"a": 11, "b": 3}[r.s] for r in numbered.collect())
    totals = ordered.running_totals(numbered, ["s"], {"run": "x"}, size).collect()
    assert all(r.run == r.x * (r.x + 1) // 2 for r in totals)
    one = df.where("s = 'a'")
    got = {r.x: r.shard for r in ordered.shards(one, "x", F.floor(F.col("x") / size), 4).collect()}
    assert got == {x: x // 3 for x in range(11)}
    assert {r.x for r in ordered.every_kth(numbered.where("s = 'a'"), 5).collect()} == {0, 5, 10}
    parts = {r.x: r.part for r in ordered.chrono_split(numbered.where("s = 'a'"), 0.7).collect()}
    assert [x for x, p in parts.items() if p == "train"] and max(x for x, p in parts.items() if p == "train") == 6


def test_explode_range_skips_empty(spark):
    df = spark.createDataFrame([(1, 0, 6), (2, 3, 2), (3, 5, 5)], "g int, lo int, hi int")
    got = sorted((r.g, r.n) for r in ordered.explode_range(df, F.col("lo"), F.col("hi"), "n", 3).collect())
    assert got == [(1, i) for i in range(7)] + [(3, 5)]


@pytest.mark.parametrize("block_rows", [8, 1000])
def test_windows_cross_blocks_and_match_slices(spark, block_rows):
    values = [None if i == 9 else float(i * i + 1) for i in range(30)]
    rows = [("a", i, v, minute(i).date()) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "s string, pos bigint, v double, d date")
    cut = ordered.sliding_windows(df, ["s"], ["v"], 5, 2, target="v", step="d", block_rows=block_rows)
    got = {r.window: (r.x_v, r.y, len(r.steps)) for r in cut.collect()}
    assert got == {w: (values[w : w + 5], values[w + 5 : w + 7], 2) for w in range(24)}
    bare = ordered.sliding_windows(df, ["s"], ["v"], 5, block_rows=block_rows)
    assert {r.window for r in bare.collect()} == set(range(26))


def test_normalised_targets_pairs_and_lag(spark):
    rows = [("a", i, float(i + 1), float(2 * i + 2)) for i in range(14)]
    df = spark.createDataFrame(rows, "s string, pos bigint, v double, d double")
    cut = ordered.sliding_windows(df, ["s"], ["v", "d"], 3, 2, target="d", step="pos")
    windows = forecast.split_windows(forecast.normalised(cut, ["v", "d"], base="d"), ["s"], 0.7)
    byw = {r.window: r for r in windows.collect()}
    assert len(byw) == 10 and byw[6].part == "train" and (byw[7].part, byw[7].part_window) == ("test", 0)
    assert byw[1].n_v == [0.0, 0.5, 1.0] and byw[1].base == 4.0 and byw[1].n_y == [1.5, 2.0]
    pairs = forecast.forecast_pairs(windows, ["s"], forecast.persistence("d", 2), 2)
    test = sorted((r.step, r.pred, r.true) for r in pairs.where("part = 'test'").collect())
    assert [p[0] for p in test] == [10, 11, 12, 13]
    assert [p[1] for p in test] == pytest.approx([20.0, 20.0, 24.0, 24.0])
    assert [p[2] for p in test] == [22.0, 24.0, 26.0, 28.0]
    errors = forecast.mean_absolute_error(forecast.lag_pairs(windows, ["s"], "d", 2), ["part"]).collect()
    assert {r.part: r.mae for r in errors} == {"train": 4.0, "test": 4.0}


def test_date_split_bounds(spark):
    days = [dt.date(2016, 1, 1), dt.date(2016, 1, 2), dt.date(2017, 12, 31), dt.date(2018, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    got = {r.day: r.part for r in ordered.date_split(df, "day", "2016-01-01", "2018-01-01").collect()}
    assert got == {days[1]: "train", days[2]: "train", days[3]: "test"}


def test_prefix_patterns(spark):
    groups = {1: "ppccc", 2: "ccccc", 3: "xpppx", 4: "xyz", 5: "p", 6: "cxcxcp"}
    rows = [(g, i, k) for g, keys in groups.items() for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "g int, i int, k string")
    row = prefixes.prefix_rates(df, "g", ["i"], "k", wanted="p", uniform="c").first()
    assert row.samples == 6
    assert row.wanted_in_two == pytest.approx(3 / 6)
    assert row.wanted_in_five == pytest.approx(3 / 6)
    assert row.first_two_alike == pytest.approx(2 / 6)
    assert row.five_uniform == pytest.approx(1 / 6)
    assert row.three_and_two == pytest.approx(3 / 6)


def test_a_crowded_hour_is_several_blocks(spark):
    """Without a block, rows of one series and hour are dealt to several ranges, and fills and numbers do not show it."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("a", i, float(i) if i % 97 == 0 else None) for i in range(1, 3000)] + [(None, i, float(i)) for i in range(5)]
        df = spark.createDataFrame(rows, "s string, t bigint, v double").repartition(5)
        blocked = ordered.with_blocks(df, ["s"], ["t"], None)
        assert blocked.where("s = 'a'").select("_key").distinct().count() >= 5
        filled = {(r.s, r.t): r.v for r in fills.forward_fill(df, ["s"], ["t"], None, ["v"]).collect()}
        assert len(filled) == len(rows)
        assert all(filled["a", i] == (float(i - i % 97) if i >= 97 else None) for i in range(1, 3000))
        numbered = {(r.s, r.t): (r.pos, r.series_rows) for r in ordered.number_rows(df, ["s"], ["t"]).collect()}
        assert all(numbered["a", i] == (i - 1, 2999) for i in range(1, 3000)) and numbered[None, 3] == (3, 5)
        sparse = spark.createDataFrame([(i * i * 1_000_003,) for i in range(1000)], "id bigint").repartition(3)
        found = ordered.shards(sparse, "id", None, 7)
        assert sorted(r["count"] for r in found.groupBy("shard").count().collect()) == [142] + [143] * 6
        assert {r.id: r.shard for r in found.collect()} == {i * i * 1_000_003: i // 143 for i in range(1000)}
        assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_the_grid_is_dealt_to_as_many_tasks_as_its_ticks_need(spark):
    """two rows make a grid of 10,000 ticks; no task gets all, whatever the size of what it is made from."""
    rows = [("a", "2020-01-01 00:00:00", 0.0), ("a", "2021-02-20 16:00:00", 1.0), (None, "2020-01-01 00:00:00", 2.0)]
    df = spark.createDataFrame(rows, "s string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    tasks = fills.grid_tasks(df, ["s"], "ts", 3600, rows=400)
    assert tasks == 25
    grid = fills.grid_fill(df, ["s"], "ts", 3600, block_ticks=100, tasks=tasks)
    whole = fills.interpolate(grid, ["s"], "tick", ["v"], block_rows=100, tasks=tasks)
    shares = whole.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in shares) == 10_000 and len(shares) > 15
    same = fills.interpolate(fills.grid_fill(df, ["s"], "ts", 3600), ["s"], "tick", ["v"])
    assert whole.exceptAll(same).isEmpty() and same.count() == 10_000
