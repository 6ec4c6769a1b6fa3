"""Exact set-similarity self join by prefix filtering.

A text's prefix is made in the task that reads it. A task packs the prefixes of many texts into one row per bucket of
tokens: sorted token differences, the texts' places in a short list, positions. What is shuffled is
a few bytes per token; the tokens of a bucket are unpacked in one task, where nearly all of them prove to be in no other
text and leave. Similar texts have many prefix tokens in common, so that some bucket must hold several of them: a class of texts
of like size is dealt to few buckets, and pairs with too few common tokens in a bucket leave in its task.
Texts of candidate pairs travel as texts, once per cell of pairs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import shingle_set
from millrace.operators.skew import pairs_within
from millrace.session import free, stage, unstage

# Guards products such as 0.8 * 15 = 12.000000000000002 when they bound counts from below.
EPS = 1e-9
#: Slots of the list of frequent tokens, and texts that it is made from, about.
SLOTS, ORDER_TEXTS = 1 << 22, 4_000
#: Prefix tokens of a bucket and candidate pairs of a cell, about; these only size tasks.
BUCKET_TOKENS, CELL_PAIRS = 1 << 20, 1 << 12
#: Prefix tokens that are packed together. A list of texts has at most as many as two bytes can number.
PACKED_TOKENS, PACKED_TEXTS = 1 << 21, 1 << 16
#: A token is packed as half of its hash. So many of a text may look alike in a bound on counts.
TIES = 2
#: Texts of one token that meet in the task of its bucket; more of them meet in cells of their own.
GROUP = 1 << 12
#: Pairs of a bucket that are counted at a time.
MET_PAIRS = 1 << 22
#: A prefix has one token in so many more than it must have, so that sets of unlike sizes have several in common, too.
MORE = 32
#: Classes of sizes: a set of n tokens is in class ``floor(log2(n))``.
CLASSES = 64


class Shingled(NamedTuple):
    """Texts ``(id, text)`` that are read as sets of ``k``-shingles."""

    texts: DataFrame
    k: int


def frequency_levels(sets: Shingled, texts: int = ORDER_TEXTS, slots: int = SLOTS) -> bytes:
    """A byte for each of ``slots``: the doubled logarithm of how many tokens fall into it.

    A token's slot is its hash modulo ``slots``, so this is a bounded list in which frequent tokens stand out.
    It comes from about ``texts`` texts drawn by id, as it only orders tokens: any order gives the same pairs.
    """
    k = sets.k
    share = F.greatest(sets.texts.select(F.ceil(F.count(F.lit(1)) / F.lit(texts))).scalar(), F.lit(1))
    drawn = sets.texts.where(F.pmod(F.xxhash64("id"), share) == 0).select("text")

    def count(batches):
        total = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            seen = np.concatenate([np.empty(0, dtype=np.uint64), *(shingle_set(x, k) for x in batch.column("text").to_pylist())])
            total += np.bincount((seen % np.uint64(slots)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "c"])

    counted = drawn.mapInArrow(count, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c"))
    levels = np.zeros(slots, dtype=np.uint8)
    # At most ``slots`` rows of five bytes.
    found = counted.select("slot", F.round(F.log2(F.col("c") + 1) * 2).cast("tinyint").alias("level")).toArrow()
    levels[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return levels.tobytes()


def _behind(n, threshold: float, greatest, ceil, floor):
    """How many of a set's ``n`` tokens lie behind its prefix; on numbers, columns or arrays."""
    return greatest(ceil(n * threshold - EPS) - 1 - floor(n / MORE), n * 0)


def prefix(tokens: np.ndarray, threshold: float, levels: np.ndarray) -> np.ndarray:
    """A set's first tokens, more than similar sets must share one of.

    Tokens are ordered by (level, hash), the same order for all, frequent ones last. Of a set of n tokens
    the first ``n - ceil(t*n) + 1`` suffice: two sets with no common token there have J < t. With more of them, as many more are common.
    """
    n = len(tokens)
    level = levels[(tokens % np.uint64(len(levels))).astype(np.int64)]
    return tokens[np.argsort(level, kind="stable")[: n - int(_behind(n, threshold, max, np.ceil, np.floor))]]


def bucket_groups(sets: Shingled, threshold: float) -> list[int]:
    """For each class of sizes the number of buckets that its tokens are dealt to, so that one holds about ``BUCKET_TOKENS``."""
    class_ = lambda n: F.length(F.bin(n)) - F.lit(1)
    size = F.length("text").cast("long")
    met = F.explode(F.sequence(class_(size), class_(F.floor(size / F.lit(threshold)))))
    sized = sets.texts.where(size >= sets.k).select(met.alias("class"), size.alias("n")).groupBy("class").agg(F.sum("n").alias("n"))
    groups = [1] * CLASSES
    for row in sized.collect():  # at most a row per class
        groups[row["class"]] = max(1, int(np.ceil(row["n"] * (1 - threshold + 1 / MORE) / BUCKET_TOKENS)))
    return groups


def _classes(n: int, threshold: float) -> range:
    """The classes of the sets of at least ``n`` tokens that a set of ``n`` may be similar to, its own first."""
    return range(n.bit_length() - 1, int(n / threshold + EPS).bit_length())


def _pack(parts: list[tuple[int, int, np.ndarray, int]], groups: list[int]):
    """A record batch with a row per bucket of the prefixes ``(id, n, tokens, class)``."""
    many = [len(p[2]) for p in parts]
    token = np.concatenate([p[2] for p in parts])
    class_ = np.repeat([p[3] for p in parts], many)
    begins, wide = np.cumsum([0, *groups[:-1]]), np.array(groups, dtype=np.uint64)
    bucket = begins[class_].astype(np.uint64) + (token >> np.uint64(32)) % wide[class_]
    key = bucket << np.uint64(32) | token & np.uint64(0xFFFFFFFF)
    text = np.repeat(np.arange(len(parts)), many)
    # The texts of a token stay in order; with the text in the key any sort keeps them so.
    few = begins[-1] + groups[-1] <= 1 << 16
    order = np.argsort(key << np.uint64(16) | text.astype(np.uint64)) if few else np.argsort(key, kind="stable")
    key, bucket, text = key[order], bucket[order], text[order]
    pos = (np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) + 1)[order].astype(np.uint32)
    ids, sizes = np.array([p[0] for p in parts], dtype=np.int64), np.array([p[1] for p in parts], dtype=np.uint32)
    rows = []
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
        in_row = np.zeros(len(parts), dtype=bool)
        in_row[text[low:high]] = True
        used, place = np.flatnonzero(in_row), (np.cumsum(in_row) - 1)[text[low:high]]
        step = np.diff(key[low:high].astype(np.uint32), prepend=np.uint32(0))
        arrays = (step, place.astype(np.uint16), pos[low:high], ids[used], sizes[used])
        # Bytes of like weight side by side: the upper ones are nearly all zero.
        planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
        rows.append((int(bucket[low]), high - low, len(used), pa.compress(planes, codec="zstd", asbytes=True)))
    b, t, u, planes = zip(*rows)
    return pa.record_batch(
        [pa.array(b, pa.int32()), pa.array(t, pa.int32()), pa.array(u, pa.int32()), pa.array(planes, pa.binary())],
        names=["bucket", "tokens", "texts", "planes"],
    )


def _unpack(tokens: int, texts: int, planes: bytes) -> tuple[np.ndarray, ...]:
    """``(token, place, pos)`` of a packed row's tokens and ``(id, n)`` of its texts, numbered by the places."""
    raw = pa.decompress(planes, tokens * 10 + texts * 12, codec="zstd", asbytes=True)
    arrays, at = [], 0
    for length, kind in ((tokens, np.uint32), (tokens, np.uint16), (tokens, np.uint32), (texts, np.int64), (texts, np.uint32)):
        size = length * np.dtype(kind).itemsize
        plane = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at).reshape(-1, length)
        arrays.append(np.ascontiguousarray(plane.T).view(kind).reshape(-1))
        at += size
    step, place, pos, ids, sizes = arrays
    return np.cumsum(step, dtype=np.uint32), place.astype(np.int64), pos.astype(np.int64), ids, sizes.astype(np.int64)


def packed_prefixes(sets: Shingled, threshold: float, levels: bytes, groups: list[int]) -> DataFrame:
    """``(bucket, tokens, texts, planes)``: the prefixes of all texts, packed, in each class that holds larger sets they may be similar to."""
    k = sets.k

    def pack(batches):
        level = np.frombuffer(levels, dtype=np.uint8)
        parts, size = [], 0
        for batch in batches:
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                tokens = shingle_set(text.as_py(), k)
                if len(tokens):
                    first = prefix(tokens, threshold, level)
                    for class_ in _classes(len(tokens), threshold):
                        parts.append((name, len(tokens), first, class_))
                        size += len(first)
                if size >= PACKED_TOKENS or len(parts) + CLASSES > PACKED_TEXTS:
                    yield _pack(parts, groups)
                    parts, size = [], 0
        if parts:
            yield _pack(parts, groups)

    given = sets.texts.select(F.col("id").cast("long").alias("id"), "text").where(F.col("id").isNotNull())
    return given.mapInArrow(pack, "bucket int, tokens int, texts int, planes binary")


def _possible(a, b, threshold: float, least, greatest, ceil):
    """Whether rows ``(n, pos)`` of a common token pass the length and position bounds; on columns or arrays."""
    needed = ceil((a["n"] + b["n"]) * (threshold / (1 + threshold)) - EPS)
    behind = least(a["n"] - a["pos"], b["n"] - b["pos"])
    return (least(a["n"], b["n"]) >= greatest(a["n"], b["n"]) * threshold - EPS) & (least(a["pos"], b["pos"]) + behind >= needed)


def _required(n1, n2, threshold: float, greatest, ceil, floor):
    """How many prefix tokens two similar sets have in common at least, less those that may look alike.

    What the prefixes do not have in common lies behind the end of the one that ends first.
    """
    needed = ceil((n1 + n2) * (threshold / (1 + threshold)) - EPS)
    behind = [_behind(n, threshold, greatest, ceil, floor) for n in (n1, n2)]
    return needed - greatest(*behind) - TIES


def _counted(token, text, pos, ids, sizes, least: int, threshold: float, at_once: int):
    """``(low, high, c)`` of texts: those whose tokens, given in order, may be in similar pairs, with the number of such tokens.
    One of two texts has at least ``least`` tokens. ``at_once`` bounds the pairs that are held."""
    many = np.unique(token, return_counts=True)[1]
    turns = max(1, int(np.ceil((many * (many - 1) // 2).sum() / at_once)))
    for turn in range(turns):
        at, found = np.flatnonzero(text % turns == turn), []
        for ahead in range(1, len(token)):
            at = at[: np.searchsorted(at, len(token) - ahead)]
            at = at[token[at] == token[at + ahead]]
            if not len(at):
                break
            x, y = text[at], text[at + ahead]
            a, b = {"n": sizes[x], "pos": pos[at]}, {"n": sizes[y], "pos": pos[at + ahead]}
            fits = _possible(a, b, threshold, np.minimum, np.maximum, np.ceil) & (np.maximum(a["n"], b["n"]) >= least) & (ids[x] != ids[y])
            found.append(x[fits] * len(ids) + y[fits])
        if found:
            pairs, c = np.unique(np.concatenate(found), return_counts=True)
            yield pairs // len(ids), pairs % len(ids), c


def _meet(threshold: float, groups: list[int]):
    """The function that unpacks a bucket and forms the pairs of its tokens.

    A pair's common tokens lie in as many buckets as its class has. It is returned by those that hold their share of what
    similar sets must have in common; at least one does.
    """
    most, at_once, ends = GROUP, MET_PAIRS, np.cumsum(groups)

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        class_ = int(np.searchsorted(ends, bucket, side="right"))
        least, g = 1 << class_, groups[class_]
        parts = [_unpack(*row) for row in zip(*(table.column(c).to_pylist() for c in ("tokens", "texts", "planes")))]
        before = np.cumsum([0] + [len(p[3]) for p in parts])
        token, pos, ids, sizes = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
        text = np.concatenate([p[1] + start for p, start in zip(parts, before)])
        order = np.argsort(token, kind="stable")
        token = token[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        many = np.diff(np.append(starts, len(token)))
        many = np.repeat(many, many)
        order, token, many = order[many > 1], token[many > 1], many[many > 1]
        text, pos = text[order], pos[order]
        hot = many > most
        found = [(np.empty(0, dtype=np.int64),) * 3]
        for low, high, c in _counted(token[~hot], text[~hot], pos[~hot], ids, sizes, least, threshold, at_once):
            enough = c * g >= _required(sizes[low], sizes[high], threshold, np.maximum, np.ceil, np.floor)
            found.append((low[enough], high[enough], c[enough]))
        low, high, c = (np.concatenate(x) for x in zip(*found))
        swap = ids[low] > ids[high]
        low, high = np.where(swap, high, low), np.where(swap, low, high)
        key = token[hot].astype(np.int64) | np.int64(bucket << 32)
        met = pa.table({"id1": ids[low], "id2": ids[high], "n1": sizes[low], "n2": sizes[high], "c": c.astype(np.int64), "g": np.full(len(c), g)})
        rows = pa.table({"h": key, "id": ids[text[hot]], "n": sizes[text[hot]], "pos": pos[hot], "df": many[hot], "g": np.full(len(key), g),
                         "least": np.full(len(key), least)})
        return pa.concat_tables([met, rows], promote_options="default").select(
            ["id1", "id2", "n1", "n2", "c", "g", "h", "id", "n", "pos", "df", "least"])

    return meet


def candidates(packed: DataFrame, threshold: float, groups: list[int]) -> DataFrame:
    """``(id1, id2)``, stored: pairs that pass the bounds by length, position and common prefix tokens. None with J >= t is missing.

    A bucket holds a bounded number of tokens, but a token can be in any number of texts. Up to ``GROUP`` of them meet at once;
    the rows of more frequent tokens are returned with their number and meet in cells of bounded size.
    """
    met = stage(packed.groupBy("bucket").applyInArrow(
        _meet(threshold, groups),
        "id1 long, id2 long, n1 long, n2 long, c long, g long, h long, id long, n long, pos long, df long, least long"), "met-tokens")
    free(met.sparkSession)
    frequent = met.where(F.col("h").isNotNull()).select("h", "id", "n", "pos", "df", "g", "least")
    possible = lambda a, b: (
        _possible(a, b, threshold, F.least, F.greatest, F.ceil) & (F.greatest(a["n"], b["n"]) >= a["least"]))
    pairs = pairs_within(frequent, ["h"], "id", "df", ["n", "pos", "g", "least"], possible).select(
        F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2"), F.lit(1).cast("long").alias("c"),
        F.col("a.g").alias("g"), F.lit(0).alias("whole"),
    )
    seen = met.where(F.col("h").isNull()).select("id1", "id2", "n1", "n2", "c", "g", F.lit(1).alias("whole")).unionByName(pairs)
    required = _required(F.col("n1"), F.col("n2"), threshold, F.greatest, F.ceil, F.floor)
    summed = seen.groupBy("id1", "id2", "n1", "n2", "g").agg(F.sum("c").alias("c"), F.sum("whole").alias("whole"))
    # A bucket that did not return the pair holds less than its share.
    unseen = F.greatest(F.col("g") - F.col("whole"), F.lit(0)) * F.greatest(F.ceil(required / F.col("g")) - F.lit(1), F.lit(0))
    found = stage(summed.where(F.col("c") + unseen >= required).select("id1", "id2").distinct(), "candidate-pairs")
    unstage(met)
    return found


def _scores(threshold: float, k: int):
    """The function that compares the pairs of a cell."""

    def score(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for name, text in zip(texts.column("id").to_pylist(), texts.column("text").to_pylist()):
            sets.setdefault(name, []).append(shingle_set(text, k))
        rows = []
        for id1, id2 in zip(pairs.column("id1").to_pylist(), pairs.column("id2").to_pylist()):
            for one in sets.get(id1, []):
                for other in sets.get(id2, []):
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    # Without shingles there is nothing to compare.
                    share = common / max(len(one) + len(other) - common, 1)
                    if share >= threshold:
                        rows.append((id1, id2, share))
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.table({"id1": pa.array(a, pa.int64()), "id2": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return score


def scored_pairs(pairs: DataFrame, sets: Shingled, threshold: float) -> DataFrame:
    """``(id1, id2, score)`` of the ``pairs`` with at least ``threshold``.

    Pairs are dealt to cells by a part of either id, as many parts as leave about ``CELL_PAIRS`` pairs to a cell. A text is sent
    once to each cell that needs it, at most twice the number of parts however many pairs it is in.
    """
    parts = max(6, int(np.ceil(np.sqrt(pairs.count() / CELL_PAIRS))))
    part = lambda id_: F.pmod(F.xxhash64(id_), F.lit(parts).cast("long"))
    dealt = pairs.withColumn("cell", part("id1") * parts + part("id2"))
    needed = dealt.select(F.col("cell").alias("home"), F.explode(F.array("id1", "id2")).alias("id")).distinct()
    texts = sets.texts.select(F.col("id").cast("long").alias("id"), "text").join(needed, "id").select("home", "id", "text")
    return dealt.groupBy("cell").cogroup(texts.groupBy("home")).applyInArrow(
        _scores(threshold, sets.k), "id1 long, id2 long, score double")


def jaccard_pairs(texts: DataFrame, threshold: float = 0.8, k: int = 10) -> DataFrame:
    """``(id1, id2, score)``: all pairs ``id1 < id2`` with Jaccard similarity ``>= threshold``; ids are whole numbers.

    Expects distinct texts (``distinct_texts``), best stored. Prefixes are made inside the row and only they are shuffled, packed.
    The texts of candidate pairs are shingled again, for the exact score.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    sets = Shingled(texts, k)
    groups = bucket_groups(sets, threshold)
    levels = frequency_levels(sets)
    free(texts.sparkSession)
    return scored_pairs(candidates(packed_prefixes(sets, threshold, levels, groups), threshold, groups), sets, threshold)
