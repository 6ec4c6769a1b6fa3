"""Equi-joins whose keys may be hot: a single key can hold a third of all rows.

Both helpers take the number of rows per key from the data, cut a hot key into parts and let each
part meet what it has to meet. Rows are never dropped; a key that is not hot costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot if it holds more rows than one task should get ...
ROWS_PER_PART = 1_000_000
# ... and more than this share of all rows. At most 1 / HOT_SHARE keys can, which bounds the
# broadcast list of hot keys whatever the size of the data.
HOT_SHARE = 1e-4


def parts_of(freq: Column, rows_per_part: int = ROWS_PER_PART) -> Column:
    """Number of parts a key with ``freq`` rows is cut into."""
    return F.ceil(freq / F.lit(rows_per_part)).cast("int")


def part_of(row_id: Column, parts: Column) -> Column:
    """The part, from 0, that a row falls into; a fixed function of its id."""
    return F.pmod(F.xxhash64(row_id), parts.cast("bigint")).cast("int")


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    row_id: str,
    freq: str,
    rows_per_part: int = ROWS_PER_PART,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Inner join of many rows with one ``lookup`` row per key, where ``freq`` counts a key's rows.

    Hot keys, a list of bounded length, are broadcast to the rows. There a hot key's rows draw a
    part, and its lookup row is repeated once per part, so the shuffle spreads them.
    """
    total = lookup.select(F.sum(freq)).scalar()
    is_hot = (F.col(freq) > F.lit(rows_per_part)) & (F.col(freq) > total * F.lit(hot_share))
    parts = parts_of(F.col(freq), rows_per_part)
    hot = lookup.where(is_hot).select(*keys, parts.alias("_parts"))
    # Bounded by 1 / hot_share keys, see above.
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_part", F.when(F.col("_parts").isNull(), 0).otherwise(part_of(F.col(row_id), F.col("_parts")))
    )
    repeated = lookup.withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.when(is_hot, parts - 1).otherwise(0)))
    )
    return marked.drop("_parts").join(repeated, [*keys, "_part"]).drop("_part")


def pairs_within(
    rows: DataFrame,
    keys: list[str],
    row_id: str,
    size: str,
    carry: list[str],
    condition,
    rows_per_cell: int = 10_000,
) -> DataFrame:
    """Pairs ``a.id < b.id`` of rows with equal keys that satisfy ``condition(a, b)``.

    ``size`` is the row's group size or an upper bound. A group is cut into parts, and each pair of
    parts is a join key of its own, so that no task meets more than two parts of a group. The
    condition is part of the join: a pair that fails it never leaves the task that looks at it.
    """
    parts = parts_of(F.col(size), rows_per_cell)
    part = part_of(F.col(row_id), parts)
    row = F.struct(F.col(row_id).alias("id"), *[F.col(c) for c in carry])
    # A row of part p meets part i in the cell of both; there the lower part leads, the other follows.
    cells = F.transform(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        lambda i: F.struct(
            F.least(i, F.col("_part")).alias("from"),
            F.greatest(i, F.col("_part")).alias("to"),
            F.signum(i - F.col("_part")).cast("int").alias("role"),
        ),
    )
    cut = rows.select(*keys, parts.alias("_parts"), part.alias("_part"), row.alias("row"))
    sent = cut.select(*keys, F.explode_outer(cells).alias("_cell"), "row").select(
        *keys, F.col("_cell.from").alias("_from"), F.col("_cell.to").alias("_to"),
        F.col("_cell.role").alias("_role"), "row",
    )
    left, right = sent.alias("l"), sent.alias("r")
    a, b = F.col("l.row"), F.col("r.row")
    # Leading rows have role 1, following ones -1, and 0 (both) in the cell of one part. Roles are
    # compared rather than tested one by one: a filter on one side would give the two sides
    # different plans, and the rows would be computed and shuffled twice instead of once.
    one, other = F.col("l._role"), F.col("r._role")
    roles = (one > other) | ((one == 0) & (other == 0))
    # Within one part each pair is met twice and kept once; across parts it is met once.
    once = (F.col("l._from") < F.col("l._to")) | (a["id"] < b["id"])
    on = roles & once & (a["id"] != b["id"]) & condition(a, b)
    for key in [*keys, "_from", "_to"]:
        on = on & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    ordered = a["id"] < b["id"]
    return left.join(right, on).select(
        *[F.col(f"l.{k}").alias(k) for k in keys],
        F.when(ordered, a).otherwise(b).alias("a"),
        F.when(ordered, b).otherwise(a).alias("b"),
    )
