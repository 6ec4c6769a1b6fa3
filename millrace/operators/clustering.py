"""Optimal one-dimensional k-means per group, and the cost of a given clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordered import BLOCK_ROWS, explode_range, number_rows
from millrace.session import stage

# Distinct values up to which a group is solved inside one task.
TASK_VALUES = 2_000
SCHEMA = "last bigint, cost double, breaks array<bigint>"


def cluster_cost(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """``(cluster, n, sse)``: squared distances of vectors to their cluster's mean, summed."""
    long = points.select(cluster, F.posexplode(F.col(vector)).alias("_dim", "_x"))
    per_dim = long.groupBy(cluster, "_dim").agg(
        F.count(F.lit(1)).alias("_n"), F.var_pop(F.col("_x").cast("double")).alias("_var")
    )
    return per_dim.groupBy(cluster).agg(
        F.max("_n").alias("n"), F.sum(F.col("_var") * F.col("_n")).alias("sse")
    )


#: Running sums, each as a double and what it lost to rounding.
SUMS = ("swx", "swx_low", "swxx", "swxx_low")


def two_sum(a, b):
    """A sum and what rounding took from it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """A product and what rounding took from it."""
    p = a * b
    ah = 134217729.0 * a - (134217729.0 * a - a)
    bh = 134217729.0 * b - (134217729.0 * b - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _plus(a, b):
    """Sum of two numbers that are each a double and its remainder."""
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + a[1] + b[1])


def segment_costs(low, high):
    """Cost of the values after ``low`` up to ``high``: running sums ``(w, swx, swx_low, swxx, swxx_low)`` at both ends.

    ``swxx - swx * swx / w`` in twice the digits of a double, as its two terms may be equal in all digits of one.
    """
    w = high[0] - low[0]
    wx = _plus((high[1], high[2]), (-low[1], -low[2]))
    wxx = _plus((high[3], high[4]), (-low[3], -low[4]))
    p, e = two_product(wx[0], wx[0])
    square = two_sum(p, e + 2 * wx[0] * wx[1])
    q = square[0] / w
    back, lost = two_product(q, w)
    rest = ((square[0] - back) - lost + square[1]) / w
    cost = _plus(wxx, (-q, -rest))
    return np.maximum(cost[0] + cost[1], 0.0)


def _running(points: pd.DataFrame) -> pd.DataFrame:
    """Running sums within one block of points, exactly but for the last digits of a double's remainder."""
    points = points.sort_values("m", ignore_index=True)
    x, w = points["x"].tolist(), points["w"].tolist()
    first = second = (0.0, 0.0)
    out = []
    for v, n in zip(x, w):
        vn = two_product(v, n)
        square = two_product(v, v)
        weighted = two_product(square[0], n)
        first = _plus(first, vn)
        second = _plus(second, (weighted[0], weighted[1] + square[1] * n))
        out.append((*first, *second))
    sums = pd.DataFrame(out, columns=list(SUMS))
    return pd.concat([points[["key", "m", "x", "w"]], points["w"].cumsum().rename("sw"), sums], axis=1)


def _carried(blocks: pd.DataFrame) -> pd.DataFrame:
    """What a group's blocks start with: the sums of the blocks before."""
    blocks = blocks.sort_values("block", ignore_index=True)
    total, first, second, out = 0.0, (0.0, 0.0), (0.0, 0.0), []
    for r in blocks.itertuples():
        out.append((r.key, r.block, total, *first, *second))
        total += r.sw
        first, second = _plus(first, (r.swx, r.swx_low)), _plus(second, (r.swxx, r.swxx_low))
    return pd.DataFrame(out, columns=["key", "block", "c_sw", *[f"c_{s}" for s in SUMS]])


def distinct_points(df: DataFrame, group: str, x: str, block: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(key, m, x, w, sw, swx, swx_low, swxx, swxx_low)``: distinct values numbered from 1, with running sums.

    ``key`` stands for the group and is never NULL, so rows of a NULL group are a group. Equal values combine before the
    shuffle, so a group costs its distinct values. ``block`` cuts long groups, see ``number_rows``; it is an
    expression on ``x`` that never decreases with it, by default ranges of about equal numbers of values.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(group_key(group).alias("key"), F.col(x).cast("double").alias("x"))
    weighted = values.agg(F.count(F.lit(1)).cast("double").alias("w"))
    numbered = number_rows(weighted, ["key"], ["x"], block).select(
        "key", (F.col("pos") + 1).alias("m"), "x", "w", F.floor(F.col("pos") / F.lit(block_rows)).alias("block")
    )
    sums = ", ".join(f"{c} double" for c in ("x", "w", "sw", *SUMS))
    local = stage(numbered.groupBy("key", "block").applyInPandas(_running, f"key string, m bigint, {sums}"), "kmeans-sums")
    cut = local.withColumn("block", F.floor((F.col("m") - 1) / F.lit(block_rows)))
    # A row per block, whose last point has the block's sums.
    ends = cut.groupBy("key", "block").agg(*[F.max_by(c, "m").alias(c) for c in ("sw", *SUMS)])
    starts = ", ".join(f"c_{c} double" for c in ("sw", *SUMS))
    carried = ends.groupBy("key").applyInPandas(_carried, f"key string, block bigint, {starts}")

    def whole(batches):
        for b in batches:
            first = _plus((b["swx"], b["swx_low"]), (b["c_swx"], b["c_swx_low"]))
            second = _plus((b["swxx"], b["swxx_low"]), (b["c_swxx"], b["c_swxx_low"]))
            out = b[["key", "m", "x", "w"]].assign(sw=b["sw"] + b["c_sw"])
            yield out.assign(**dict(zip(SUMS, (*first, *second))))

    return cut.join(carried, ["key", "block"]).mapInPandas(whole, f"key string, m bigint, {sums}")


def group_key(group: str) -> Column:
    """A string for each group, for NULL too, which leaves no join."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("?"))


@F.pandas_udf(T.DoubleType())
def _costs(low: pd.DataFrame, high: pd.DataFrame) -> pd.Series:
    sides = [[side[c].to_numpy() for c in ("sw", *SUMS)] for side in (low, high)]
    return pd.Series(segment_costs(*sides))


def segment_cost(low: str, high: str) -> Column:
    """:func:`segment_costs` of two columns that hold the running sums."""
    return _costs(F.col(low), F.col(high))


def _solve_in_task(points: pd.DataFrame, k: int) -> tuple[int, float, list[int]]:
    """Last value's number, best cost and the ends of the first k-1 clusters, of one small group."""
    sums = [np.concatenate([[0.0], points[c].to_numpy()]) for c in ("sw", *SUMS)]
    d = len(points)

    def cost(low: np.ndarray, high: int) -> np.ndarray:
        return segment_costs([s[low] for s in sums], [np.full(len(low), s[high]) for s in sums])

    best = np.full(d + 1, np.inf)
    best[1:] = [cost(np.array([0]), m)[0] for m in range(1, d + 1)]
    came_from = []
    for h in range(2, k + 1):
        layer, choice = np.full(d + 1, np.inf), np.zeros(d + 1, dtype=int)
        for m in range(h, d + 1):
            ends = np.arange(h - 1, m)
            totals = best[ends] + cost(ends, m)
            at = int(np.argmin(totals))
            layer[m], choice[m] = totals[at], ends[at]
        best = layer
        came_from.append(choice)
    breaks, m = [], d
    for choice in reversed(came_from):
        m = int(choice[m])
        breaks.append(m)
    return d, float(best[d]), breaks[::-1]


def _small_groups(points: DataFrame, group: str, k: int) -> DataFrame:
    def solve(key: tuple, group_points: pd.DataFrame) -> pd.DataFrame:
        last, cost, breaks = _solve_in_task(group_points.sort_values("m"), k)
        return pd.DataFrame({group: [key[0]], "last": [last], "cost": [cost], "breaks": [breaks]})

    field = points.schema[group]
    schema = f"`{group}` {field.dataType.simpleString()}, {SCHEMA}"
    return points.groupBy(group).applyInPandas(solve, schema)


def _best_ends(ranges: DataFrame, previous: DataFrame, points: DataFrame, group: str) -> DataFrame:
    """For rows ``(group, m, low, high)`` the best end ``low <= l <= high`` of the clusters before.

    The ends are spread as rows of their own; ``(group, l)`` and ``(group, m)`` are the join keys.
    """
    sums = F.struct("sw", *SUMS)
    left = previous.select(group, F.col("m").alias("l"), F.col("cost").alias("_before"), sums.alias("_low"))
    right = points.select(group, "m", sums.alias("_high"))
    tried = explode_range(ranges, F.col("low"), F.col("high"), "l")
    priced = tried.join(left, [group, "l"]).join(right, [group, "m"])
    total = F.col("_before") + segment_cost("_low", "_high")
    others = [c for c in ranges.columns if c not in (group, "m")]
    best = priced.groupBy(group, "m", *others).agg(F.min(F.struct(total.alias("cost"), "l")).alias("_b"))
    return best.select(group, "m", *others, F.col("_b.cost").alias("cost"), F.col("_b.l").alias("l"))


def _large_groups(points: DataFrame, group: str, k: int) -> DataFrame:
    """Layer by layer; within a layer by halving, because best ends never decrease with ``m``.

    All groups advance together. A round looks at about as many rows as there are values, where the
    plain recurrence would look at all pairs of values; a layer takes log2(values) rounds.
    """
    points = stage(points, "kmeans-large")
    sizes = points.groupBy(group).agg(F.max("m").alias("d"))
    rounds = int(points.agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]).bit_length()
    origin = F.struct(*[F.lit(0.0).alias(c) for c in ("sw", *SUMS)])
    priced = points.withColumns({"_low": origin, "_high": F.struct("sw", *SUMS)})
    one = priced.select(group, "m", segment_cost("_low", "_high").alias("cost"), F.lit(0).cast("bigint").alias("l"), "sw", *SUMS)
    layers, previous = [], one
    for h in range(2, k):
        todo = sizes.where(F.col("d") >= h).select(
            group, F.lit(h).cast("bigint").alias("first"), F.col("d").alias("last"),
            F.lit(h - 1).cast("bigint").alias("from"), (F.col("d") - 1).alias("to"),
        )
        solved = None
        for _ in range(rounds):
            middle = F.floor((F.col("first") + F.col("last")) / 2).cast("bigint")
            asked = todo.withColumn("m", middle).select(
                "*", F.col("from").alias("low"), F.least(F.col("to"), F.col("m") - 1).alias("high")
            )
            found = stage(_best_ends(asked, previous, points, group), f"kmeans-{h}")
            row = found.select(group, "m", "cost", "l")
            solved = row if solved is None else solved.unionByName(row)
            below = found.select(
                group, "first", (F.col("m") - 1).alias("last"), "from", F.col("l").alias("to"))
            above = found.select(
                group, (F.col("m") + 1).alias("first"), "last", F.col("l").alias("from"), "to")
            todo = below.unionByName(above).where(F.col("first") <= F.col("last"))
        previous = stage(solved.join(points.drop("x", "w"), [group, "m"]), f"kmeans-layer-{h}")
        layers.append(previous.select(group, "m", "l"))
    final = sizes.where(F.col("d") >= k).select(
        group, F.col("d").alias("m"), F.lit(k - 1).cast("bigint").alias("low"), (F.col("d") - 1).alias("high")
    )
    if k == 1:
        return one.join(sizes.select(group, F.col("d").alias("m")), [group, "m"]).select(
            group, F.col("m").alias("last"), "cost", F.array().cast("array<bigint>").alias("breaks")
        )
    best = _best_ends(final, previous, points, group)
    traced = best.select(
        group, F.col("m").alias("last"), "cost", F.array("l").alias("breaks"), F.col("l").alias("_m")
    )
    for layer in reversed(layers):
        step = layer.select(group, F.col("m").alias("_m"), F.col("l").alias("_l"))
        traced = traced.join(step, [group, "_m"]).select(
            group, "last", "cost", F.concat(F.array("_l"), "breaks").alias("breaks"), F.col("_l").alias("_m")
        )
    return traced.drop("_m")


def kmeans_1d(
    df: DataFrame,
    group: str,
    x: str,
    k: int,
    block: Column | None = None,
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """``(group, cluster, low, high, n, cost)``: the optimal k clusters of each group's values.

    ``cost`` is the group's total; of equally good clusterings the one with the smallest ends is
    taken, from the last cluster back. A group with fewer distinct values than ``k`` has none and
    gets one row with NULLs. Groups of few distinct values are solved in a task each, after a check
    of their number; larger ones by joins that spread their values. Both price clusters by the same function, in twice the
    digits of a double. Rows of a NULL group are a group; NULL values are no values.
    """
    named = df.groupBy(group_key(group).alias("key")).agg(F.first(group).alias("_name"))
    points = stage(distinct_points(df, group, x, block), "kmeans-points")
    sizes = points.groupBy("key").agg(F.max("m").alias("_d"))
    sized = points.join(sizes, "key")
    fits = sized.where((F.col("_d") >= k) & (F.col("_d") <= task_values)).drop("_d")
    exceeds = sized.where((F.col("_d") >= k) & (F.col("_d") > task_values)).drop("_d")
    solved = _small_groups(fits, "key", k)
    if not exceeds.isEmpty():
        solved = solved.unionByName(_large_groups(exceeds, "key", k))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), "breaks", F.array("last"))
    clusters = solved.withColumn("_ends", ends).select(
        "key", "cost", F.posexplode(F.slice("_ends", 1, k)).alias("cluster", "_after"), "_ends"
    ).withColumn("_until", F.get("_ends", F.col("cluster") + 1))
    edge = points.select("key", "m", "x", "sw", (F.col("sw") - F.col("w")).alias("_sw0"))
    first = edge.select("key", (F.col("m") - 1).alias("_after"), F.col("x").alias("low"), F.col("_sw0").alias("_s0"))
    last = edge.select("key", F.col("m").alias("_until"), F.col("x").alias("high"), F.col("sw").alias("_s1"))
    found = clusters.join(first, ["key", "_after"]).join(last, ["key", "_until"]).select(
        "key", "cluster", "low", "high", (F.col("_s1") - F.col("_s0")).cast("bigint").alias("n"), "cost"
    )
    none = sizes.where(F.col("_d") < k).select(
        "key", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns[1:]]
    )
    return found.unionByName(none).join(named, "key").select(F.col("_name").alias(group), *found.columns[1:])
