"""Regular grids and gap filling, per series and block (see ``ordered``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import along_blocks, block_key, explode_range, with_blocks
from millrace.session import partition_by

# Rows of a grid that one task sorts, about.
TASK_ROWS = 500_000


def forward_fill(
    df: DataFrame, series: list[str], order: list[str], block: Column | None, columns: list[str]
) -> DataFrame:
    """Replace NULLs by the last value before them in the series; leading NULLs stay.

    Within a block by a window; across blocks each block's last value is carried over, which takes
    one row per block.
    """
    blocked = with_blocks(df, series, order, block)
    at = F.struct(*order)
    tails = blocked.groupBy("_key").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_tail_{c}") for c in columns]
    )
    earlier = along_blocks(series).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        "_key", *[F.last(f"_tail_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns]
    )
    so_far = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})
    filled = local.join(carried, "_key").withColumns({c: F.coalesce(c, f"_in_{c}") for c in columns})
    return filled.drop("_key", *[f"_in_{c}" for c in columns])


def constant_fill(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """Replace NULLs by a constant."""
    return df.na.fill(value, subset=columns)


def _spans(df: DataFrame, series: list[str], ts: str, step: int, closed: bool) -> DataFrame:
    """``(series..., _first, _end)``: where each series' grid begins and the number of its last tick."""
    micros = F.unix_micros(F.col(ts))
    ends = df.groupBy(*series).agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"))
    span = F.col("_last") - F.col("_first")
    ticks = F.floor(span / F.lit(step)) + 1 if closed else F.ceil(span / F.lit(step))
    return ends.where(ticks > 0).select(*series, "_first", (ticks - 1).cast("bigint").alias("_end"))


def grid_tasks(df: DataFrame, series: list[str], ts: str, step_seconds: int, closed: bool = False, rows: int = TASK_ROWS) -> int:
    """How many tasks a grid needs for about ``rows`` ticks each, ``spark.sql.shuffle.partitions`` at least. One number passes the driver."""
    spans = _spans(df, series, ts, step_seconds * 1_000_000, closed)
    ticks = spans.select(F.sum(F.col("_end") + 1)).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ticks // rows))


def grid_fill(
    df: DataFrame,
    series: list[str],
    ts: str,
    step_seconds: int,
    closed: bool = False,
    block_ticks: int = 4096,
    tasks: int | None = None,
) -> DataFrame:
    """One row per grid tick from a series' first to its last timestamp, the last one excluded.

    Adds ``tick``, the tick's number from 0. Rows off the grid vanish; missing ones are NULL. The
    grid is laid out in blocks of ticks, so that a long series' ticks are made by many tasks. The grid may be far larger than
    ``df``; ``tasks`` (:func:`grid_tasks`) is into how many tasks it is dealt.
    """
    step = step_seconds * 1_000_000
    spans = _spans(df, series, ts, step, closed)
    laid_out = explode_range(spans, F.lit(0), F.col("_end"), "tick", block_ticks, tasks)
    grid = laid_out.select(
        *series, F.timestamp_micros(F.col("_first") + F.col("tick") * F.lit(step)).alias(ts), "tick"
    )
    # A struct key, because a NULL series has a grid like any other.
    key = F.struct(*[F.col(c) for c in [*series, ts]])
    known = df.withColumn("_key", key).drop(*series, ts)
    keyed = grid.withColumn("_key", key)
    if tasks:
        keyed, known = (partition_by(x, "_key", tasks=tasks) for x in (keyed, known))
    return keyed.join(known, "_key", "left").drop("_key")


def interpolate(
    df: DataFrame, series: list[str], pos: str, columns: list[str], block_rows: int = 4096, tasks: int | None = None
) -> DataFrame:
    """Fill NULLs linearly by position; leading NULLs stay, trailing ones take the last value.

    ``pos`` numbers a series' rows without gaps (``tick`` of :func:`grid_fill`, or ``number_rows``).
    The nearest known value on either side comes from the row's own block, else from the nearest
    block that has one. With ``tasks`` the blocks are dealt to so many, and a task sorts its share of the rows only.
    """
    blocked = df.withColumn("_key", block_key(series, F.floor(F.col(pos) / F.lit(block_rows))))
    if tasks:
        blocked = partition_by(blocked, "_key", tasks=tasks)
    at = {c: F.when(F.col(c).isNotNull(), F.col(pos)) for c in columns}
    ends = []
    for c in columns:
        ends += [
            F.min_by(c, at[c]).alias(f"_hv_{c}"),
            F.min(at[c]).alias(f"_hp_{c}"),
            F.max_by(c, at[c]).alias(f"_tv_{c}"),
            F.max(at[c]).alias(f"_tp_{c}"),
        ]
    summary = blocked.groupBy("_key").agg(*ends)
    # "What comes next" is "what came last" in descending order: a frame that ends at the current
    # row is kept up as rows go by, one that starts there is evaluated anew for each row.
    along = along_blocks(series)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = along.orderBy(F.desc("_key._block")).rowsBetween(Window.unboundedPreceding, -1)
    borders = []
    for c in columns:
        borders += [
            F.last(f"_tv_{c}", ignorenulls=True).over(before).alias(f"_bv_{c}"),
            F.last(f"_tp_{c}", ignorenulls=True).over(before).alias(f"_bp_{c}"),
            F.last(f"_hv_{c}", ignorenulls=True).over(after).alias(f"_av_{c}"),
            F.last(f"_hp_{c}", ignorenulls=True).over(after).alias(f"_ap_{c}"),
        ]
    carried = summary.select("_key", *borders)

    in_block = Window.partitionBy("_key")
    so_far = in_block.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    to_come = in_block.orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    near = {}
    for c in columns:
        near[f"_pv_{c}"] = F.last(c, ignorenulls=True).over(so_far)
        near[f"_pp_{c}"] = F.last(at[c], ignorenulls=True).over(so_far)
        near[f"_nv_{c}"] = F.last(c, ignorenulls=True).over(to_come)
        near[f"_np_{c}"] = F.last(at[c], ignorenulls=True).over(to_come)
    joined = blocked.withColumns(near).join(carried, "_key")

    def filled(c: str) -> Column:
        left_v, left_p = F.coalesce(f"_pv_{c}", f"_bv_{c}"), F.coalesce(f"_pp_{c}", f"_bp_{c}")
        right_v, right_p = F.coalesce(f"_nv_{c}", f"_av_{c}"), F.coalesce(f"_np_{c}", f"_ap_{c}")
        slope = (right_v - left_v) * (F.col(pos) - left_p) / (right_p - left_p)
        return (
            F.when(F.col(c).isNotNull() | left_p.isNull(), F.col(c))
            .when(right_p.isNull(), left_v)
            .otherwise(left_v + slope)
        )

    others = [name for name in df.columns if name not in columns]
    return joined.select(*others, *[filled(c).alias(c) for c in columns]).select(*df.columns)
