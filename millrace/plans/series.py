"""Time-series queries: per-user price ticks from ``events``, daily prices from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import bars, fills, forecast, ordered
from millrace.session import stage
from millrace.sources.tables import table

HOUR = 3600
N_IN, N_OUT = 15, 4
RATIO = 0.7
AFTER, UNTIL = "1998-01-01", "2000-01-01"
KTH = 50
FEATURES = ["low", "high", "mean"]
SERIES = ["o_orderpriority"]


def _ticks(spark, folder):
    """Prices are seen at purchases only; other events carry none."""
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    seen = F.when(F.col("event_type") == "purchase", F.col("value"))
    return events.select("user_id", "event_id", "ts", seen.alias("price"), seen.alias("volume"))


def _filled(spark, folder):
    carried = fills.forward_fill(_ticks(spark, folder), ["user_id"], ["ts", "event_id"], None, ["price"])
    return fills.constant_fill(carried, ["volume"])


def _hours(spark, folder):
    return bars.tick_bars(_filled(spark, folder), ["user_id"], "ts", "event_id", "hour", "price", "volume")


def _grid(spark, folder):
    """The hourly grid and the number of tasks it is dealt to. The hours are stored, as they are read three times."""
    hours = stage(_hours(spark, folder), "hours")
    tasks = fills.grid_tasks(hours, ["user_id"], "ts", HOUR)
    return fills.grid_fill(hours, ["user_id"], "ts", HOUR, tasks=tasks), tasks


VALUES = ["open", "high", "low", "close", "volume"]


def _whole(spark, folder):
    grid, tasks = _grid(spark, folder)
    return fills.interpolate(grid, ["user_id"], "tick", VALUES, tasks=tasks)


def ffill(spark, folder):
    return _filled(spark, folder).select("user_id", "event_id", "price", "volume")


def _hour_number():
    return F.floor(F.unix_timestamp("ts") / F.lit(HOUR)).alias("hour")


def grid_fill(spark, folder):
    values = [F.round(c, 6).alias(c) if c == "volume" else F.col(c) for c in VALUES]
    return _grid(spark, folder)[0].select("user_id", "tick", _hour_number(), *values)


def interpolate(spark, folder):
    values = [F.round(c, 8).alias(c) for c in VALUES]
    return _whole(spark, folder).select("user_id", "tick", *values)


def daily_bars(spark, folder):
    daily = bars.daily_bars(_whole(spark, folder), ["user_id"])
    values = [F.round(c, 6).alias(c) for c in ["open", "close", "low", "high", "volume", "mean"]]
    return daily.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *values)


def _price_days(orders, series):
    exact = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return orders.groupBy(*series, F.to_date("o_orderdate").alias("day")).agg(
        F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"),
        (exact / F.count(F.lit(1))).alias("mean"),
    )


def _numbered(spark, folder):
    orders = table(spark, folder, "orders", "o_orderdate", "o_orderpriority", "o_totalprice")
    return ordered.number_rows(_price_days(orders, SERIES), SERIES, ["day"], F.year("day"))


def _windows(spark, folder, n_out):
    cut = ordered.sliding_windows(
        _numbered(spark, folder), SERIES, FEATURES, N_IN, n_out, target="mean", step="day"
    )
    return forecast.split_windows(forecast.normalised(cut, FEATURES, base="mean"), SERIES, RATIO)


def sliding_windows(spark, folder):
    zipped = F.arrays_zip(F.col("steps").alias("step"), F.col("y").alias("y"), F.col("n_y").alias("y_norm"))
    rows = _windows(spark, folder, N_OUT).select(
        *SERIES, "window", "base", F.posexplode(zipped).alias("h", "r")
    )
    return rows.select(
        *SERIES, "window", F.col("h").cast("bigint").alias("h"), "base",
        F.date_format("r.step", "yyyy-MM-dd").alias("step"), "r.y", F.round("r.y_norm", 8).alias("y_norm"),
    )


def _bare_windows(spark, folder):
    cut = ordered.sliding_windows(_numbered(spark, folder), SERIES, ["mean"], N_IN)
    return forecast.normalised(cut, ["mean"], base="mean")


def sliding_norm(spark, folder):
    zipped = F.arrays_zip(F.col("x_mean").alias("x"), F.col("n_mean").alias("n"))
    rows = _bare_windows(spark, folder).select(*SERIES, "window", F.posexplode(zipped).alias("at", "r"))
    return rows.select(
        *SERIES, "window", F.col("at").cast("bigint").alias("at"), "r.x", F.round("r.n", 8).alias("n")
    )


def denormalise(spark, folder):
    back = vectors.absolute(F.col("n_mean"), F.col("base"))
    rows = _bare_windows(spark, folder).select(*SERIES, "window", F.posexplode(back).alias("at", "x"))
    return rows.select(*SERIES, "window", F.col("at").cast("bigint").alias("at"), F.round("x", 4).alias("x"))


def forecast_pairs(spark, folder):
    pairs = forecast.forecast_pairs(
        _windows(spark, folder, N_OUT), SERIES, forecast.persistence("mean", N_OUT), N_OUT
    )
    return pairs.select(
        *SERIES, "part", F.date_format("step", "yyyy-MM-dd").alias("step"), F.round("pred", 4).alias("pred"), "true"
    )


def chrono_split(spark, folder):
    split = ordered.chrono_split(_numbered(spark, folder), RATIO)
    return split.select(*SERIES, F.date_format("day", "yyyy-MM-dd").alias("day"), "pos", "part", "mean")


def date_split(spark, folder):
    # The bound on the stored timestamp reaches the scan, the exact one on the day follows.
    orders = spark.read.parquet(f"{folder}/orders.parquet").where(
        F.col("o_orderdate") > F.lit(AFTER).cast("timestamp_ntz")
    )
    split = ordered.date_split(_price_days(orders, []), "day", AFTER, UNTIL)
    return split.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "part", "mean")


def lag_mae(spark, folder):
    rows = None
    for lag in (1, N_OUT):
        pairs = forecast.lag_pairs(_windows(spark, folder, lag), SERIES, "mean", lag)
        errors = forecast.mean_absolute_error(pairs, [*SERIES, "part"])
        row = errors.select(
            F.lit(lag).cast("bigint").alias("lag"), *SERIES, "part", "n", F.round("mae", 6).alias("mae")
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def every_kth(spark, folder):
    chosen = ordered.every_kth(_numbered(spark, folder), KTH)
    return chosen.select(*SERIES, "pos", F.date_format("day", "yyyy-MM-dd").alias("label"))


QUERIES = {
    "ffill": ffill,
    "grid_fill": grid_fill,
    "interpolate": interpolate,
    "daily_bars": daily_bars,
    "sliding_windows": sliding_windows,
    "sliding_norm": sliding_norm,
    "denormalise": denormalise,
    "forecast_pairs": forecast_pairs,
    "chrono_split": chrono_split,
    "date_split": date_split,
    "lag_mae": lag_mae,
    "every_kth": every_kth,
}

_FILLED = """e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events),
        f AS (SELECT user_id, event_id, ts, coalesce(v, 0) AS volume,
                     last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM e)"""
_GRID = f"""{_FILLED},
        b AS (SELECT user_id, date_trunc('hour', ts) AS ts, first(price ORDER BY ts, event_id) AS open,
                     max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close,
                     sum(volume) AS volume
              FROM f GROUP BY user_id, date_trunc('hour', ts)),
        g0 AS (SELECT user_id, unnest(range(0, h)) AS tick, first_ts
               FROM (SELECT user_id, min(ts) AS first_ts,
                            (epoch(max(ts)) - epoch(min(ts)))::BIGINT // {HOUR} AS h FROM b GROUP BY user_id)),
        g AS (SELECT g0.user_id, g0.tick, g0.first_ts + to_hours(g0.tick) AS ts,
                     b.open, b.high, b.low, b.close, b.volume
              FROM g0 LEFT JOIN b ON b.user_id = g0.user_id AND b.ts = g0.first_ts + to_hours(g0.tick))"""


def _between(c: str) -> str:
    return f"""CASE WHEN {c} IS NOT NULL OR pp_{c} IS NULL THEN {c} WHEN np_{c} IS NULL THEN pv_{c}
               ELSE pv_{c} + (nv_{c} - pv_{c}) * (tick - pp_{c}) / (np_{c} - pp_{c}) END AS {c}"""


_NEAR = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER back AS pv_{c}, "
    f"last_value(CASE WHEN {c} IS NOT NULL THEN tick END IGNORE NULLS) OVER back AS pp_{c}, "
    f"first_value({c} IGNORE NULLS) OVER ahead AS nv_{c}, "
    f"first_value(CASE WHEN {c} IS NOT NULL THEN tick END IGNORE NULLS) OVER ahead AS np_{c}"
    for c in VALUES
)
_WHOLE = f"""{_GRID},
        near AS (SELECT *, {_NEAR} FROM g
                 WINDOW back AS (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        ahead AS (PARTITION BY user_id ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        w AS (SELECT user_id, tick, ts, {', '.join(_between(c) for c in VALUES)} FROM near)"""
_DAILY = """d AS (SELECT o_orderpriority, o_orderdate::DATE AS day, min(o_totalprice) AS low,
                         max(o_totalprice) AS high,
                         sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean
                  FROM orders GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) - 1 AS pos,
                     count(*) OVER (PARTITION BY o_orderpriority) AS total FROM d)"""


def _cut(n_out: int) -> str:
    """Window starts with their part, number in the part, base and last value."""
    return f"""s0 AS (SELECT o_orderpriority, pos AS "window", mean AS base,
                     total - {N_IN + n_out} + 1 AS w FROM n WHERE pos + {N_IN + n_out} <= total),
        s AS (SELECT *, CASE WHEN "window" < floor(w * {RATIO}::DOUBLE) THEN 'train' ELSE 'test' END AS part,
                     CASE WHEN "window" < floor(w * {RATIO}::DOUBLE) THEN "window"
                          ELSE "window" - floor(w * {RATIO}::DOUBLE)::BIGINT END AS part_window FROM s0)"""


ORACLE = {
    "ffill": f"WITH {_FILLED} SELECT user_id, event_id, price, volume FROM f",
    "grid_fill": f"""
        WITH {_GRID}
        SELECT user_id, tick, epoch(ts)::BIGINT // {HOUR} AS hour, open, high, low, close,
               round(volume, 6) AS volume FROM g""",
    "interpolate": f"""
        WITH {_WHOLE}
        SELECT user_id, tick, {', '.join(f'round({c}, 8) AS {c}' for c in VALUES)} FROM w""",
    "daily_bars": f"""
        WITH {_WHOLE},
        k AS (SELECT user_id, ts::DATE AS day, first(open ORDER BY ts) AS open, last(close ORDER BY ts) AS close,
                     min(low) AS low, max(high) AS high, sum(volume) AS volume FROM w GROUP BY 1, 2)
        SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(open, 6) AS open, round(close, 6) AS close,
               round(low, 6) AS low, round(high, 6) AS high, round(volume, 6) AS volume,
               round((high + close) / 2, 6) AS mean FROM k""",
    "sliding_windows": f"""
        WITH {_DAILY}, {_cut(N_OUT)}
        SELECT s.o_orderpriority, s."window", n.pos - s."window" - {N_IN} AS h, s.base,
               strftime(n.day, '%Y-%m-%d') AS step, n.mean AS y, round(n.mean / s.base - 1, 8) AS y_norm
        FROM s JOIN n ON n.o_orderpriority = s.o_orderpriority
         AND n.pos BETWEEN s."window" + {N_IN} AND s."window" + {N_IN + N_OUT - 1}""",
    "sliding_norm": f"""
        WITH {_DAILY}, {_cut(0)}
        SELECT s.o_orderpriority, s."window", n.pos - s."window" AS at, n.mean AS x,
               round(n.mean / s.base - 1, 8) AS n
        FROM s JOIN n ON n.o_orderpriority = s.o_orderpriority
         AND n.pos BETWEEN s."window" AND s."window" + {N_IN - 1}""",
    "denormalise": f"""
        WITH {_DAILY}, {_cut(0)}
        SELECT s.o_orderpriority, s."window", n.pos - s."window" AS at,
               round((n.mean / s.base - 1 + 1) * s.base, 4) AS x
        FROM s JOIN n ON n.o_orderpriority = s.o_orderpriority
         AND n.pos BETWEEN s."window" AND s."window" + {N_IN - 1}""",
    "forecast_pairs": f"""
        WITH {_DAILY}, {_cut(N_OUT)}
        SELECT s.o_orderpriority, s.part, strftime(n.day, '%Y-%m-%d') AS step,
               round((l.mean / s.base - 1 + 1) * s.base, 4) AS pred, n.mean AS "true"
        FROM s JOIN n ON n.o_orderpriority = s.o_orderpriority
         AND n.pos BETWEEN s."window" + {N_IN} AND s."window" + {N_IN + N_OUT - 1}
        JOIN n l ON l.o_orderpriority = s.o_orderpriority AND l.pos = s."window" + {N_IN - 1}
        WHERE s.part_window % {N_OUT} = 0""",
    "chrono_split": f"""
        WITH {_DAILY}
        SELECT o_orderpriority, strftime(day, '%Y-%m-%d') AS day, pos,
               CASE WHEN pos < floor(total * {RATIO}::DOUBLE) THEN 'train' ELSE 'test' END AS part, mean FROM n""",
    "date_split": f"""
        SELECT strftime(o_orderdate::DATE, '%Y-%m-%d') AS day,
               CASE WHEN o_orderdate::DATE < DATE '{UNTIL}' THEN 'train' ELSE 'test' END AS part,
               sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean
        FROM orders WHERE o_orderdate::DATE > DATE '{AFTER}' GROUP BY o_orderdate::DATE""",
    "lag_mae": " UNION ALL ".join(
        f"""(WITH {_DAILY}, {_cut(lag)}
        SELECT {lag}::BIGINT AS lag, s.o_orderpriority, s.part, count(*) AS n,
               round(avg(abs(l.mean - n.mean)), 6) AS mae
        FROM s JOIN n ON n.o_orderpriority = s.o_orderpriority AND n.pos = s."window" + {N_IN}
        JOIN n l ON l.o_orderpriority = s.o_orderpriority AND l.pos = s."window" + {N_IN - lag}
        GROUP BY s.o_orderpriority, s.part)"""
        for lag in (1, N_OUT)
    ),
    "every_kth": f"""
        WITH {_DAILY}
        SELECT o_orderpriority, pos, strftime(day, '%Y-%m-%d') AS label FROM n WHERE pos % {KTH} = 0""",
}
