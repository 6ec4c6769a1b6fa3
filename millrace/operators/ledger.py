"""Replay of buy and sell orders under cash and position limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import bind
from millrace.operators.ordered import number_rows
from millrace.session import stage

# Action codes, anything else holds; the quantity of every trade.
BUY, SELL = 0, 1
LOT = 0.5


# Steps of an account that are folded as one array, and as one inner array of it.
CHUNK, PIECE = 4096, 64


def priced_steps(
    orders: DataFrame, account: str, order: list[str], price: str, action: str, block: Column | None, chunk: int = CHUNK
) -> DataFrame:
    """``(key, account, order..., price, action, pos, chunk, next_price, final)``: rows with the price after them.

    The last row of an account has no price after it and makes no step; the one before is final. ``chunk`` numbers
    runs of as many rows of an account; its last row takes the first price of the next one, so no window covers
    more than a chunk.
    """
    rows = orders.select(
        # The key stands for the account in joins, where a NULL account would leave.
        F.coalesce(F.concat(F.lit("="), F.col(account).cast("string")), F.lit("?")).alias("key"),
        F.col(account).alias("account"), *order, F.col(price).cast("double").alias("price"), F.col(action).alias("action"),
    )
    numbered = number_rows(rows, ["key"], order, block).withColumn("chunk", F.floor(F.col("pos") / F.lit(chunk)))
    opening = numbered.where((F.col("pos") > 0) & (F.col("pos") % chunk == 0)).select(
        "key", (F.col("chunk") - 1).alias("chunk"), F.col("price").alias("_after")
    )
    within = Window.partitionBy("key", "chunk").orderBy("pos")
    led = numbered.withColumn("next_price", F.lead("price").over(within)).join(opening, ["key", "chunk"], "left")
    steps = led.where(F.col("pos") < F.col("series_rows") - 1)
    at_end = F.col("pos") % chunk == chunk - 1
    return steps.withColumns(
        {
            "next_price": F.when(at_end, F.col("_after")).otherwise(F.col("next_price")),
            "final": F.col("pos") == F.col("series_rows") - 2,
        }
    ).drop("_after", "series_rows")


def _step(state: Column, x: Column, budget: float) -> Column:
    """``(refused, cash, held, reward)`` after one step from a state with ``cash`` and ``held``."""
    cost = x["price"] * LOT
    buy, sell = x["action"] == BUY, x["action"] == SELL
    refused = (buy & (state["cash"] < cost)) | (sell & (state["held"] < LOT))
    bought, sold = buy & (state["cash"] >= cost), sell & (state["held"] >= LOT)
    cash = F.when(bought, state["cash"] - cost).when(sold, state["cash"] + cost).otherwise(state["cash"])
    held = F.when(bought, state["held"] + LOT).when(sold, state["held"] - LOT).otherwise(state["held"])
    base = F.when(x["final"], F.lit(budget)).otherwise(state["cash"] + state["held"] * x["price"])
    made = F.struct(refused.alias("refused"), cash.alias("cash"), held.alias("held"))
    return bind(made, lambda m: F.struct(
        m["refused"].alias("refused"), m["cash"].alias("cash"), m["held"].alias("held"),
        F.try_divide(m["cash"] + m["held"] * x["next_price"], base).alias("reward"),
    ))


def _fold(steps: Column, cash: Column, held: Column, budget: float, row: list[str], types: dict[str, str]) -> Column:
    """The rows of sorted ``steps`` with what each came to, by an ``aggregate`` inside the row.

    Appending to an array copies it, so steps are folded in pieces: what is copied are a piece's rows and a chunk's pieces.
    """
    fields = ", ".join([*[f"`{c}`: {types[c]}" for c in row], "refused: boolean", "cash: double", "held: double", "reward: double"])
    kind = f"array<struct<{fields}>>"

    def one(state: Column, x: Column) -> Column:
        return bind(_step(state, x, budget), lambda m: F.struct(
            m["cash"].alias("cash"), m["held"].alias("held"),
            F.concat(state["out"], F.array(F.struct(*[x[c].alias(c) for c in row], *[m[c].alias(c) for c in ("refused", "cash", "held", "reward")]))
                     .cast(kind)).alias("out"),
        ))

    def piece(state: Column, at: Column) -> Column:
        start = F.struct(state["cash"].alias("cash"), state["held"].alias("held"), F.array().cast(kind).alias("out"))
        return bind(F.aggregate(F.slice(steps, at + 1, PIECE), start, one), lambda m: F.struct(
            m["cash"].alias("cash"), m["held"].alias("held"), F.concat(state["out"], F.array(m["out"])).alias("out")
        ))

    start = F.struct(cash.alias("cash"), held.alias("held"), F.array().cast(f"array<{kind}>").alias("out"))
    starts = F.sequence(F.lit(0), F.size(steps) - 1, F.lit(PIECE))
    return F.aggregate(starts, start, piece, lambda s: F.struct(s["cash"].alias("cash"), s["held"].alias("held"), F.flatten(s["out"]).alias("out")))


def replay(
    orders: DataFrame,
    account: str,
    order: list[str],
    price: str,
    action: str,
    block: Column | None,
    budget: float,
    chunk: int = CHUNK,
) -> DataFrame:
    """Per step ``(account, order..., action, refused, cash, position, reward)``.

    A trade happens at the row's price, its outcome is valued at the next one. A buy is refused when
    cash falls short of a lot, a sale when less than a lot is held. The reward is the value after over
    the value before, at an account's last step the value over the starting budget. At a NULL price nothing is traded and
    nothing valued; whether the order is refused is then NULL.

    Whether an order is refused depends on all orders before it, so an account's steps cannot be replayed out of
    order. They are cut into chunks of ``chunk`` rows, each one array, which is folded inside its row; a round folds one chunk of
    every account that has it, from the states that the round before has stored. Most tables need one round.
    """
    prepared = priced_steps(orders, account, order, price, action, block, chunk)
    row = ["account", *order, "action"]
    entry = F.struct("pos", *row, "price", "next_price", "final")
    chunks = prepared.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(entry)).alias("steps"))
    chunks = stage(chunks, "ledger-chunks")
    rounds = (chunks.agg(F.max("chunk")).first()[0] or 0) + 1
    types = {c: prepared.schema[c].dataType.simpleString() for c in row}
    state, results = None, []
    for n in range(rounds):
        todo = chunks.where(F.col("chunk") == n)
        started = todo.withColumns({"cash": F.lit(float(budget)), "held": F.lit(0.0)}) if state is None else todo.join(state, "key")
        folded = started.select("key", _fold(F.col("steps"), F.col("cash"), F.col("held"), float(budget), row, types).alias("done"))
        if rounds > 1:
            folded = stage(folded, f"ledger-{n}")
            state = folded.select("key", "done.cash", "done.held")
        results.append(folded.select(F.inline("done.out")))
    replayed = results[0]
    for more in results[1:]:
        replayed = replayed.unionByName(more)
    return replayed.select(F.col("account").alias(account), *order, "action", "refused", "cash", F.col("held").alias("position"), "reward")


def taken(replayed: DataFrame, action: int) -> DataFrame:
    """The steps with one action code, e.g. all buys."""
    return replayed.where(F.col("action") == action)
