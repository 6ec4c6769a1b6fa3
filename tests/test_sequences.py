from __future__ import annotations

import random
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from millrace.operators import clustering, ledger


def best_clustering(values, k):
    """All ways to cut the sorted distinct values, the cheapest first."""
    xs = sorted(set(values))
    options = []
    for cuts in combinations(range(1, len(xs)), k - 1):
        ends = [0, *cuts, len(xs)]
        cost = 0.0
        for lo, hi in zip(ends, ends[1:]):
            inside = [v for v in values if v in xs[lo:hi]]
            mean = sum(inside) / len(inside)
            cost += sum((v - mean) ** 2 for v in inside)
        options.append((cost, [(xs[lo], xs[hi - 1]) for lo, hi in zip(ends, ends[1:])]))
    return min(options) if options else None


GROUPS = {
    "spread": [1, 2, 2, 3, 10, 11, 25, 26, 26, 40],
    "random": [random.Random(9).randrange(60) for _ in range(25)],
    "equal": [4, 4, 4],
    "exact": [1, 5, 9],
}


@pytest.mark.parametrize("task_values", [0, 1000])
@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_kmeans_is_optimal_in_a_task_and_by_joins(spark, k, task_values):
    rows = [(g, float(v)) for g, values in GROUPS.items() for v in values]
    df = spark.createDataFrame(rows, "g string, x double")
    blocks = F.floor(F.col("x") / 10)
    found = clustering.kmeans_1d(df, "g", "x", k, block=blocks, task_values=task_values).collect()
    for g, values in GROUPS.items():
        mine = sorted((r for r in found if r.g == g), key=lambda r: r.cluster or 0)
        best = best_clustering([float(v) for v in values], k)
        if best is None:
            assert [(r.cluster, r.cost) for r in mine] == [(None, None)]
            continue
        assert mine[0].cost == pytest.approx(best[0], abs=1e-9)
        assert len(mine) == k and sum(r.n for r in mine) == len(values)
        cost = 0.0
        for r in mine:
            inside = [v for v in values if r.low <= v <= r.high]
            assert r.n == len(inside)
            cost += sum((v - sum(inside) / len(inside)) ** 2 for v in inside)
        assert cost == pytest.approx(best[0], abs=1e-9)


FAR = {
    "far": ([0.0, 1.7e9, 1, 2, 3, 9, 11, 12, 25, 26, 39, 40], [(0, 12), (25, 26), (39, 40), (1.7e9, 1.7e9)]),
    "negative": ([-1.7e9, 1, 2, 3, 9, 11, 12, 25, 26, 39, 40], [(-1.7e9, -1.7e9), (1, 12), (25, 26), (39, 40)]),
    None: ([0.0, 10, 20, 30, 1000.5, 1000.5], [(0, 10), (20, 20), (30, 30), (1000.5, 1000.5)]),
}


@pytest.mark.parametrize("task_values", [2, 1000])
def test_far_values_null_groups_and_ties(spark, task_values):
    """Costs keep their digits beside a far value; a NULL group is a group; of equal costs the smallest ends win."""
    rows = [(g, float(v)) for g, (values, _) in FAR.items() for v in values] + [("far", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    found = clustering.kmeans_1d(df, "g", "x", 4, task_values=task_values).collect()
    assert {r.g for r in found} == set(FAR)
    for g, (values, expected) in FAR.items():
        mine = sorted((r for r in found if r.g == g), key=lambda r: r.cluster)
        if g is not None:  # the tie's ends are checked between the solvers below
            assert [(r.low, r.high) for r in mine] == expected
        exact = sum(
            sum((Fraction(v) - sum(map(Fraction, own)) / len(own)) ** 2 for v in own)
            for r in mine for own in [[v for v in values if r.low <= v <= r.high]]
        )
        assert mine[0].cost == pytest.approx(float(exact), abs=1e-9) and mine[0].cost >= 0
        assert float(exact) == pytest.approx(best_clustering(values, 4)[0] if g is None else float(exact))
    ties = [[(r.low, r.high) for r in sorted(rows, key=lambda r: r.cluster)] for rows in (
        [r for r in found if r.g is None],
        [r for r in clustering.kmeans_1d(df, "g", "x", 4, task_values=1002 - task_values).collect() if r.g is None],
    )]
    assert ties[0] == ties[1]


def test_sums_in_twice_the_digits():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (rng.uniform(-1, 1) * 10.0 ** rng.randrange(-8, 12) for _ in range(2))
        s, e = clustering.two_sum(a, b)
        assert Fraction(s) + Fraction(e) == Fraction(a) + Fraction(b)
        p, e = clustering.two_product(a, b)
        assert Fraction(p) + Fraction(e) == Fraction(a) * Fraction(b)


def test_cluster_cost(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [2.0, 4.0]), (2, [5.0, 5.0])], "c int, v array<double>")
    assert {r.c: (r.n, r.sse) for r in clustering.cluster_cost(df, "c", "v").collect()} == {1: (2, 10.0), 2: (1, 0.0)}


def replay(prices, actions, budget):
    cash, held, out = budget, 0.0, []
    for i in range(len(prices) - 1):
        before, price = cash + held * prices[i], prices[i]
        refused = False
        if actions[i] == 0:
            refused = cash < 0.5 * price
            if not refused:
                cash, held = cash - 0.5 * price, held + 0.5
        elif actions[i] == 1:
            refused = held < 0.5
            if not refused:
                cash, held = cash + 0.5 * price, held - 0.5
        after = cash + held * prices[i + 1]
        base = budget if i == len(prices) - 2 else before
        out.append((refused, cash, held, after / base))
    return out


@pytest.mark.parametrize("size, chunk, piece", [(3, 3, 2), (7, 4, 64), (None, 1, 1), (None, 4096, 3)])
def test_ledger_is_the_same_however_it_is_cut(spark, monkeypatch, size, chunk, piece):
    monkeypatch.setattr(ledger, "PIECE", piece)
    draw = random.Random(4)
    rows, expected = [], {}
    for account, n in (("a", 20), ("b", 5), ("c", 1), ("d", 2)):
        prices = [float(draw.randrange(1, 60)) for _ in range(n)]
        actions = [draw.randrange(3) for _ in range(n)]
        offset = draw.randrange(5)
        rows += [(account, offset + i, p, a) for i, (p, a) in enumerate(zip(prices, actions))]
        expected.update({(account, offset + i): r for i, r in enumerate(replay(prices, actions, 40.0))})
    df = spark.createDataFrame(rows, "account string, seq int, price double, action int")
    block = F.floor(F.col("seq") / size) if size else None
    done = ledger.replay(df, "account", ["seq"], "price", "action", block, 40.0, chunk)
    got = {(r.account, r.seq): (r.refused, r.cash, r.position, r.reward) for r in done.collect()}
    assert got == expected
    assert any(r[0] for r in got.values()) and not all(r[0] for r in got.values())
    buys = {(r.account, r.seq) for r in ledger.taken(done, ledger.BUY).collect()}
    assert buys == {(a, s) for a, s, _, action in rows if action == 0 and (a, s) in expected}
