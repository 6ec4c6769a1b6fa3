"""NULL keys, windows longer than a block, values far from zero, and other rows that are easily lost."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import clustering, fills, ledger, minhash, ordered
from millrace.session import release, stage, unstage
from millrace.sources import pages

ROWS = [("a", 1, 1.0), ("a", 2, None), (None, 1, 5.0), (None, 3, None), ("b", None, 2.0), ("b", 4, None), (None, None, 7.0)]


def frame(spark):
    return spark.createDataFrame(ROWS, "s string, t bigint, v double")


def test_null_keys_keep_their_rows(spark):
    df = frame(spark)
    block = F.floor(F.col("t") / 2)
    filled = {(r.s, r.t): r.v for r in fills.forward_fill(df, ["s"], ["t"], block, ["v"]).collect()}
    assert filled == {("a", 1): 1.0, ("a", 2): 1.0, (None, 1): 5.0, (None, 3): 5.0, ("b", None): 2.0, ("b", 4): 2.0, (None, None): 7.0}
    numbered = ordered.number_rows(df, ["s"], ["t"], block)
    assert {(r.s, r.t): (r.pos, r.series_rows) for r in numbered.collect()} == {
        ("a", 1): (0, 2), ("a", 2): (1, 2), (None, None): (0, 3), (None, 1): (1, 3), (None, 3): (2, 3), ("b", None): (0, 2), ("b", 4): (1, 2)
    }
    totals = ordered.running_totals(numbered.na.fill(0.0), ["s"], {"sum": "v"}, block_rows=1)
    assert {(r.s, r.pos): r["sum"] for r in totals.collect()}[(None, 2)] == 12.0
    between = fills.interpolate(numbered, ["s"], "pos", ["v"], block_rows=1)
    assert between.count() == len(ROWS)
    assert {(r.s, r.pos): r.v for r in between.collect()}[(None, 2)] == 5.0


def test_grid_of_a_null_series_keeps_values(spark):
    at = [dt.datetime(2024, 1, 1, h) for h in (0, 2, 3)]
    df = spark.createDataFrame([(None, at[0], 1.0), (None, at[1], 2.0), (None, at[2], 3.0)], "s string, ts timestamp, v double")
    got = [r.v for r in fills.grid_fill(df, ["s"], "ts", 3600).orderBy("tick").collect()]
    assert got == [1.0, None, 2.0]


def test_ledger_keeps_a_null_account(spark):
    rows = [(None, i, 1.0 + i, i % 3) for i in range(9)] + [("x", i, 2.0, 0) for i in range(4)]
    df = spark.createDataFrame(rows, "acct string, t bigint, price double, action int")
    found = ledger.replay(df, "acct", ["t"], "price", "action", F.floor(F.col("t") / 2), 10.0).collect()
    assert sorted((r.acct or "", r.t) for r in found) == [("", i) for i in range(8)] + [("x", i) for i in range(3)]


@pytest.mark.parametrize("block_rows", [1, 2, 3, 4, 5, 6, 7, 29, 64])
def test_windows_longer_than_a_block(spark, block_rows):
    df = spark.range(30).select(F.lit(None).cast("string").alias("s"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    found = ordered.sliding_windows(df, ["s"], ["v"], 5, 2, "v", block_rows=block_rows).collect()
    assert sorted((r.window, r.x_v, r.y) for r in found) == [
        (i, [float(i + k) for k in range(5)], [i + 5.0, i + 6.0]) for i in range(24)
    ]


def test_bands_must_fit_the_signature(spark):
    sigs = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 5])], "id bigint, sig array<int>")
    assert minhash.lsh_pairs(sigs, 2, 2).count() == 1
    with pytest.raises(Exception, match="hashes are needed"):
        minhash.bands(sigs, 3, 2).collect()
    with pytest.raises(ValueError):
        minhash.bands(sigs, 0, 2)


@pytest.mark.parametrize("offset", [0.0, 1.7e9, 1.7e12])
@pytest.mark.parametrize("task_values", [1000, 2])
def test_clusters_do_not_depend_on_the_offset(spark, offset, task_values):
    points = [1, 2, 3, 7, 9, 11, 25, 26, 40, 40]
    df = spark.createDataFrame([("g", offset + x) for x in points], "g string, x double")
    found = clustering.kmeans_1d(df, "g", "x", 3, task_values=task_values).orderBy("cluster").collect()
    assert [(r.low - offset, r.high - offset, r.n) for r in found] == [(1, 11, 6), (25, 26, 2), (40, 40, 2)]
    mean = sum(points[:6]) / 6
    assert found[0].cost == pytest.approx(sum((x - mean) ** 2 for x in points[:6]) + 0.5, abs=1e-6)


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 10_000 + '<li><p class="locale">Rome<p class="title">Job &amp; more'
    df = spark.createDataFrame([(1, deep), (2, "<li>" * 1_500 + '<p class="locale">Oslo'), (3, None)], "page_id bigint, html string")
    found = {r.page_id: (r.title, r.city) for r in pages.listings(df).collect()}
    assert found == {1: ("Job & more", "Rome"), 2: (None, "Oslo")}
    own = pages.listings(df, lambda html: [{"title": str(len(html))}] if html else [])
    assert {r.page_id: r.title for r in own.collect()} == {1: str(len(deep)), 2: str(1_500 * 4 + len('<p class="locale">Oslo'))}


def test_one_staged_table_can_be_deleted(spark):
    kept, gone = stage(spark.range(3), "kept"), stage(spark.range(4), "gone")
    unstage(gone)
    assert kept.count() == 3 and not os.path.exists(gone.staged_path) and os.path.exists(kept.staged_path)


def test_staged_tables_can_be_released(spark):
    random.seed(1)
    df = stage(spark.range(3), "released")
    assert df.count() == 3
    release(spark)
    with pytest.raises(Exception):
        stage(spark.range(1), "other")
        df.collect()
