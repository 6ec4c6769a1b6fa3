"""Mixing sources to target weights, with native expressions only.

The words of a source form one line, its documents in hash order, and the line is cut into blocks of ``BLOCK``
words. A source's target gives its number of output slots. All slots are dealt to output shards of ``SHARD``
slots by a pseudorandom permutation: a shard's source counts are a multinomial draw, conditioned on the totals of
all shards, so that every source meets its target to within a block. Slot ``j`` of a source takes block
``permutation(j mod blocks)`` in pass ``j div blocks``, each pass with a permutation of its own: no block is used
again before all others were, and slots and blocks are joined by index.

Targets: the sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 1.5 times all words; a
target stops at twice its source's size and the excess goes to the others by weight.

Permutations are Feistel networks over a grid just larger than the range; a value outside the range is sent
through again. So no task sorts a source, and equal input gives equal output however it is partitioned.

Defined results: null or empty texts have size 0 and are taken 0 times; a null source is a source; rows that are
equal in every column are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, partitions_for, unused, word_count
from millrace.session import stage

BLOCK, SHARD = 64, 1024
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Rows of a source that one task numbers, about; slots that one task writes at a time.
ROWS_PER_BUCKET, SLOTS_PER_CHUNK = 20_000, 4096
ROUNDS, WALKS = 4, 32


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of ``0 .. n - 1`` for every key.

    The grid has fewer than ``sqrt(n) + 1`` cells outside the range, so ``WALKS`` steps always suffice for n up to
    1000; beyond, that they do not has probability below n^-16, and would end the job, not give a wrong block.
    """
    high = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    low = F.floor((n + high - 1) / high).cast("bigint")

    def once(v: Column) -> Column:
        a, b = F.floor(v / low).cast("bigint"), F.pmod(v, low)
        for i in range(ROUNDS):
            if i % 2:
                b = F.pmod(b + F.pmod(F.xxhash64(a, F.lit(i), *key), low), low)
            else:
                a = F.pmod(a + F.pmod(F.xxhash64(b, F.lit(i), *key), high), high)
        return a * low + b

    first = once(x)  # compiled; the walk, which is interpreted, is for the few that need it
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    checked = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("permutation left its range")).cast("bigint"))
    return F.when(first < n, first).otherwise(checked)


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(id, line, row, size)``: ``line`` names the source (null apart), ``row`` is a hash of the whole row."""
    return docs.select(
        F.col(key).alias("id"),
        line_of(F.col(source)).alias("line"),
        F.xxhash64(*[docs[c] for c in docs.columns]).alias("row"),
        word_count(F.col(text)).alias("size"),
    )


def line_of(source: Column) -> Column:
    """A key that is never null and sorts as the sources do, null last."""
    return F.when(source.isNotNull(), F.concat(F.lit("s"), source.cast("string"))).otherwise("t")


def targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per line ``(line, source_size, target, blocks, slots, first_slot, all_slots)``; few rows, one per source."""
    totals = sizes.groupBy("line").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy(F.lit(0))
    weighed = totals.withColumn("_at", (F.row_number().over(whole.orderBy("line")) - 1) % len(WEIGHTS)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("_at") + 1).cast("double")
    )
    # Filling to one level per weight: in order of size by weight, those below the level stop at their size.
    by_level = whole.orderBy(F.col("source_size") / F.col("weight"), "line")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    asked = F.lit(SHARE) * F.sum("source_size").over(whole)
    level = (asked - F.coalesce(F.sum(F.lit(MOST) * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("_level", level).withColumn(
        "_stops", F.lit(MOST) * F.col("source_size") <= F.col("_level") * F.col("weight")
    )
    final = F.max(F.when(~F.col("_stops"), F.col("_level"))).over(whole)
    most = (F.lit(MOST) * F.col("source_size")).cast("double")
    filled = levels.withColumn("target", F.when(F.col("_stops"), most).otherwise(F.least(final * F.col("weight"), most)))
    size, blocks = F.col("source_size"), F.ceil(F.col("source_size") / F.lit(block)).cast("bigint")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("bigint")
    part = F.when(size > 0, F.round((F.col("target") - passes * size) / size * F.col("blocks"))).otherwise(0).cast("bigint")
    slotted = filled.withColumn("blocks", blocks).withColumn("slots", passes * F.col("blocks") + part)
    order = whole.orderBy("line")
    return slotted.select(
        "line", "source_size", "target", "blocks", "slots",
        (F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("slots")).alias("first_slot"),
        F.sum("slots").over(whole).alias("all_slots"),
    )


def placed(sizes: DataFrame) -> DataFrame:
    """Every row with its ``start`` on the line of its source, lines being filled in hash order."""
    buckets = max(16, sizes.count() // ROWS_PER_BUCKET)
    dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    inner = Window.partitionBy("line", "bucket").orderBy("row", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("line").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("line", "bucket").agg(F.sum("size").alias("size")).select(
        "line", "bucket", F.coalesce(F.sum("size").over(outer), F.lit(0)).alias("base")
    )
    inside = dealt.withColumn("start", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return inside.join(bases, ["line", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base", "bucket")


def slots(plan: DataFrame, seed: int = 0, shard: int = SHARD) -> DataFrame:
    """``(shard, slot, line, pass, block)`` of every output slot."""
    chunks = plan.where("slots > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / F.lit(SLOTS_PER_CHUNK)).cast("bigint")))
    ).repartition(partitions_for(plan), "line", "chunk")
    first = F.col("chunk") * SLOTS_PER_CHUNK
    each = chunks.withColumn("j", F.explode(F.sequence(first, F.least(first + SLOTS_PER_CHUNK, F.col("slots")) - 1)))
    out = permuted(F.col("first_slot") + F.col("j"), F.col("all_slots"), F.lit(seed))
    turn = F.floor(F.col("j") / F.col("blocks")).cast("int")
    return each.select(
        F.floor(out / F.lit(shard)).alias("shard"), F.pmod(out, F.lit(shard)).alias("slot"), "line", turn.alias("pass"),
        permuted(F.pmod("j", "blocks"), F.col("blocks"), F.lit(seed), F.col("line"), turn).alias("block"),
    )


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows cut at the borders of blocks: ``block``, ``start_word`` in the document and ``words``."""
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / F.lit(block)), F.floor((end - 1) / F.lit(block))
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(end, (F.col("block") + 1) * block)
    return cut.withColumns({"start_word": low - F.col("start"), "words": high - low})


def mixed(rows: DataFrame, plan: DataFrame, seed: int = 0, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix: each slot with the document pieces of its block, joined by source and index.

    Both sides grow from few rows inside the stage that the join reads, so their size is underestimated: the hint
    keeps either from being broadcast.
    """
    return slots(plan, seed, shard).hint("merge").join(pieces(rows, block), ["line", "block"])


def taken(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """``(id, size, source_size, target, taken)`` per row of ``docs``."""
    rows = stage(placed(stage(sized(docs, key, source, text), "sized")), "placed")
    plan = stage(targets(rows), "targets")
    sums = mixed(rows, plan, seed).groupBy("line", "start").agg(F.sum("words").alias("taken"))
    full = rows.where("size > 0").join(sums, ["line", "start"], "left").unionByName(
        rows.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    )
    return full.join(plan.select("line", "source_size", "target"), "line").select(
        "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """``docs`` as the mix takes them: a row per document and pass, its text cut to the words taken.

    Words keep the white space that follows them. A text taken whole stays as it is.
    """
    columns = docs.columns
    rows = stage(placed(stage(sized(docs, key, source, text), "sized")), "placed")
    plan = stage(targets(rows), "targets")
    parts = mixed(rows, plan, seed).groupBy("id", "row", "line", "start", "size", "pass").agg(
        F.array_sort(F.collect_list(F.struct("start_word", "words"))).alias("_parts"), F.sum("words").alias("_taken")
    )
    held, own, row, whole, parts_, units = (unused(docs, f"_{x}") for x in ("id", "key", "row", "whole", "parts", "units"))
    parts = parts.select(
        F.col("id").alias(held), F.col("row").alias(row), F.col("_parts").alias(parts_), (F.col("_taken") == F.col("size")).alias(whole)
    )
    # Rows equal in every column have one hash; each of them has parts of its own.
    given = docs.withColumn(own, F.xxhash64(*[docs[c] for c in columns])).dropDuplicates([key, own])
    found = F.regexp_extract_all(F.col(text), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(parts_, lambda p: F.slice(
        F.col(units), (p["start_word"] + 1).cast("int"), p["words"].cast("int")))), "")
    met = given.join(parts, (F.col(own) == F.col(row)) & F.col(key).eqNullSafe(F.col(held))).withColumn(
        units, F.when(~F.col(whole), found)
    )
    return met.select(*[F.when(F.col(whole), F.col(text)).otherwise(cut).alias(c) if c == text else met[c] for c in columns])
