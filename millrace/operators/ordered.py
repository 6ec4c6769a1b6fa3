"""Row positions and row-count windows that hold when one series has most of the rows.

A window partitioned by series alone puts a whole series into one task. Here a series is cut into
blocks: the per-row work runs per (series, block), and only one summary row per block is looked at
per series. ``block`` is any expression that never decreases along the order (a day, a week, a
range of ids), chosen so that a block fits a task, or left out: :func:`with_blocks` then makes blocks of about equal size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import stage

# Rows of a position block; the windows below reach a few rows beyond it.
BLOCK_ROWS = 65_536


def block_key(series: list[str], block: Column) -> Column:
    """Series and block as one struct. Structs with equal fields are equal even if a field is NULL, in
    windows, groups and joins alike, so a NULL series or order key keeps its rows; and a join on the
    struct that a window was partitioned by needs no shuffle of its own."""
    return F.struct(*[F.col(c) for c in series], block.alias("_block"))


def along_blocks(series: list[str], key: str = "_key"):
    """The blocks of one series in order, from rows with a :func:`block_key`."""
    whole = [F.struct(*[F.col(f"{key}.{c}") for c in series])] if series else [F.lit(0)]
    return Window.partitionBy(*whole).orderBy(F.col(f"{key}._block"))


def with_blocks(df: DataFrame, series: list[str], order: list[str], block: Column | None) -> DataFrame:
    """Add ``_key``, the :func:`block_key`. Without a ``block`` rows are dealt by ranges of series and order, whose limits
    Spark draws so that each holds about as many rows, and a range is a block: however many rows a series has in however
    short a time, they are several tasks' work. The dealt rows are stored, since limits drawn again would differ."""
    if block is not None:
        return df.withColumn("_key", block_key(series, block))
    dealt = df.repartitionByRange(*series, *order).withColumn("_block", F.spark_partition_id())
    return stage(dealt.withColumn("_key", F.struct(*series, "_block")).drop("_block"), "ranges")


def number_rows(df: DataFrame, series: list[str], order: list[str], block: Column | None = None) -> DataFrame:
    """Add ``pos``, a row's position in its series from 0, and ``series_rows``, the series' length."""
    blocked = with_blocks(df, series, order, block)
    counts = blocked.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    if series or block is not None:
        blocks = along_blocks(series)
        before = blocks.rowsBetween(Window.unboundedPreceding, -1)
        whole = blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        offsets = counts.select(
            "_key",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("series_rows"),
        )
    else:
        offsets = _range_offsets(counts)
    in_block = Window.partitionBy("_key").orderBy(*order)
    numbered = blocked.withColumn("_at", F.row_number().over(in_block)).join(offsets, "_key")
    return numbered.withColumn("pos", F.col("_before") + F.col("_at") - 1).drop("_key", "_at", "_before")


def _range_offsets(counts: DataFrame) -> DataFrame:
    """Offsets of the ranges of a whole table: a row per range, no more than shuffle partitions, pass the driver."""
    rows, before = [], 0
    for at, n in sorted(tuple(r) for r in counts.select("_key._block", "_n").collect()):
        rows.append((at, before))
        before += n
    known = counts.sparkSession.createDataFrame(rows, "_block int, _before bigint")
    return known.select(F.struct("_block").alias("_key"), "_before", F.lit(before).cast("bigint").alias("series_rows"))


def sums_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``, the sum of ``value`` over all rows before in ``order``; equal rows of the order count as one after another.

    Rows are dealt by ranges of the order and added up within each; the ranges' own sums, one per range, pass the driver.
    """
    blocked = with_blocks(df, [], order, None)
    totals = blocked.groupBy("_key").agg(F.sum(value).alias("_n"))
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(_range_offsets(totals).select("_key", "_before"), "_key")
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop("_key", "_before", "_inside")


def explode_range(
    df: DataFrame, low: Column, high: Column, name: str, block: int = BLOCK_ROWS, tasks: int | None = None
) -> DataFrame:
    """One row per integer from ``low`` to ``high``, both included, in the new column ``name``.

    In two steps, first one row per block, then its integers, with a shuffle between: one wide range
    becomes many tasks' work and no long array is built. Empty ranges give no row. Adaptive execution sees the short rows of
    blocks and may put all into a few tasks; ``tasks`` fixes their number.
    """
    ranged = df.withColumn("_low", low.cast("bigint")).withColumn("_high", high.cast("bigint"))
    ranged = ranged.where(F.col("_low") <= F.col("_high"))
    firsts = F.sequence(F.col("_low"), F.col("_high"), F.lit(block).cast("bigint"))
    cut = ranged.withColumn("_at", F.explode(firsts)).repartition(*([tasks] if tasks else []), *df.columns, "_at")
    until = F.least(F.col("_high"), F.col("_at") + F.lit(block - 1))
    return cut.withColumn(name, F.explode(F.sequence(F.col("_at"), until))).drop("_low", "_high", "_at")


def running_totals(
    numbered: DataFrame, series: list[str], columns: dict[str, str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add running sums along ``pos``: ``columns`` maps a new name to the column it adds up."""
    blocked = numbered.withColumn("_key", block_key(series, F.floor(F.col("pos") / F.lit(block_rows))))
    sums = blocked.groupBy("_key").agg(*[F.sum(c).alias(f"_s_{new}") for new, c in columns.items()])
    before = along_blocks(series).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        "_key", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_in_{n}") for n in columns]
    )
    so_far = Window.partitionBy("_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({n: F.sum(c).over(so_far) for n, c in columns.items()})
    joined = local.join(carried, "_key").withColumns({n: F.col(n) + F.col(f"_in_{n}") for n in columns})
    return joined.drop("_key", *[f"_in_{n}" for n in columns])


def every_kth(numbered: DataFrame, k: int) -> DataFrame:
    """Every ``k``-th row of a numbered frame, the first included."""
    return numbered.where(F.col("pos") % k == 0)


def chrono_split(numbered: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Add ``part``: 'train' for the first ``floor(n * ratio)`` rows of a series, else 'test'."""
    cut = F.floor(F.col("series_rows") * F.lit(ratio))
    return numbered.withColumn("part", F.when(F.col("pos") < cut, "train").otherwise("test"))


def date_split(df: DataFrame, day: str, after: str, until: str) -> DataFrame:
    """Add ``part``: 'train' strictly between the two dates, 'test' from ``until`` on; others leave."""
    start, end = F.lit(after).cast("date"), F.lit(until).cast("date")
    kept = df.where(F.col(day) > start)
    return kept.withColumn("part", F.when(F.col(day) < end, "train").otherwise("test"))


def shards(df: DataFrame, order: str, block: Column | None, k: int) -> DataFrame:
    """Add ``shard``: ``k`` contiguous runs of ``ceil(n / k)`` rows, the last ones shorter or empty."""
    numbered = number_rows(df, [], [order], block)
    length = F.ceil(F.col("series_rows") / F.lit(k))
    return numbered.withColumn("shard", F.floor(F.col("pos") / length)).drop("series_rows")


def sliding_windows(
    numbered: DataFrame,
    series: list[str],
    features: list[str],
    n_in: int,
    n_out: int = 0,
    target: str | None = None,
    step: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Windows of ``n_in`` rows and the ``n_out`` rows after them, one per start position.

    Returns ``(series..., window, x_<feature>..., y, steps)``, arrays in row order, from a frame with
    ``pos``; ``y`` and ``steps`` hold the target and step column of the rows that follow. Only full
    windows are returned; ``n_windows`` counts a series' windows if the frame has ``series_rows``. A row
    is sent to every block in which a window that holds it starts, so a span may be longer than a block.
    """
    span = n_in + n_out
    home = F.floor(F.col("pos") / F.lit(block_rows))
    first = F.greatest(F.floor((F.col("pos") - F.lit(span - 1)) / F.lit(block_rows)), F.lit(0))
    counted = ["series_rows"] if "series_rows" in numbered.columns else []
    columns = [*features, *([target] if target else []), *([step] if step else []), *counted]
    columns = list(dict.fromkeys(columns))
    sent = numbered.select(
        *series,
        "pos",
        *columns,
        F.explode(F.sequence(first, home)).alias("_block"),
    )
    ahead = Window.partitionBy(*series, "_block").orderBy("pos")

    def gather(column: str, start: int, end: int) -> Column:
        # collect_list leaves NULLs out; wrapped in a struct they stay.
        rows = F.collect_list(F.struct(F.col(column).alias("v"))).over(ahead.rowsBetween(start, end))
        return F.transform(rows, lambda r: r["v"])

    outputs = [(F.col(c) - F.lit(span - 1)).alias("n_windows") for c in counted]
    outputs += [gather(f, 0, n_in - 1).alias(f"x_{f}") for f in features]
    if n_out and target:
        outputs.append(gather(target, n_in, span - 1).alias("y"))
    if n_out and step:
        outputs.append(gather(step, n_in, span - 1).alias("steps"))
    reach = F.count(F.lit(1)).over(ahead.rowsBetween(0, span - 1))
    windows = sent.select(*series, F.col("pos").alias("window"), "_block", reach.alias("_reach"), *outputs)
    at_home = F.col("_block") == F.floor(F.col("window") / F.lit(block_rows))
    return windows.where(at_home & (F.col("_reach") == span)).drop("_block", "_reach")
