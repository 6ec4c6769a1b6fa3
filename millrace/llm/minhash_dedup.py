"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A document's set is its distinct word pairs (``words`` of them; the whole sequence as one if it is shorter), its
words being lower-cased in A-Z. Documents of equal sets are one node. SuperMinHash gives each element, at level
0, 1, 2 ..., a rank (level plus a uniform number) at one more slot of a permutation of its own; a slot keeps the
smallest rank. Once every slot of a document is below the next level, no later level can change it and the
document is finished: early stopping, which long documents reach at the first levels.

Nodes that agree in one band are candidates. Every bucket is first verified as a star around its most central
member, the one that shares most buckets. The buckets whose members then still lie in several components are
searched in cells of bounded size: parts of a bucket meet in a task, and of the pairs in different components
those that hold are returned, as few as connect them. So copies are never expanded into pairs, and no pair that
shares a band goes unexamined unless its ends are connected already.

Band settings: at a similarity of 0.8 a pair misses all of 24 bands of 4 with probability (1 - 0.8^4)^24 = 3e-6.

Defined results: a null or empty text has size 0 and is linked with nothing; rows with a null id are returned
unlinked, with a null component, and kept; repeated ids count as documents of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, lean, sole_cache
from millrace.llm.components import components
from millrace.session import stage

ROWS, BANDS = 4, 24
PERCENT = 80
#: Members of a bucket that meet in one task are at most twice as many.
PART = 256
#: Shingles that are ranked together.
CHUNK = 1 << 17
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Nothing is remembered here; what others remember goes when words are hashed.
_WORDS: dict = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased in A-Z."""
    sole_cache("words", _WORDS)
    # Hashing a word again takes less time than looking it up among hundreds of thousands.
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None, words: int = 2) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    width = min(words, len(w))
    x = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - width + 1 + i])
    return np.unique(x)


def digest(text: Column, words: int = 2) -> Column:
    """The digest that names the shingle set of a text, null if it is empty."""

    @F.pandas_udf("binary")
    def digested(texts: pd.Series) -> pd.Series:
        sets = [shingle_set(x, words) for x in texts]
        return pd.Series([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], index=texts.index, dtype=object)

    return digested(text)


def super_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures, one row per non-empty set."""
    out = np.full((len(sets), size), np.inf)
    first = 0
    while first < len(sets):
        last, room = first, 0
        while last < len(sets) and (last == first or room + len(sets[last]) <= CHUNK):
            room += len(sets[last])
            last += 1
        _rank(sets[first:last], out[first:last], size)
        first = last
    return out


def _rank(sets, out, size):
    element = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = out.reshape(-1)
    permuted = None
    for level in range(size):
        x = mixed(element + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        rank = (x >> np.uint64(24)).astype(np.float64) * 2.0**-40 + level
        slot = level + (((x & np.uint64(0xFFFFFF)) * np.uint64(size - level)) >> np.uint64(24)).astype(np.int64)
        if level == 0:
            here, first_slot = slot, slot
        else:
            if permuted is None:
                permuted = np.tile(np.arange(size, dtype=np.int16), (len(element), 1))
                row = np.arange(len(element))
                permuted[row, first_slot] = 0
                permuted[row, 0] = first_slot
            row = np.arange(len(element))
            here = permuted[row, slot].astype(np.int64)
            permuted[row, slot] = permuted[:, level]
            permuted[:, level] = here
        np.minimum.at(flat, doc * size + here, rank)
        open_ = out.max(axis=1) >= level + 1
        if not open_.any():
            return
        keep = open_[doc]
        if not keep.all():
            element, doc = element[keep], doc[keep]
            if permuted is None:
                first_slot = first_slot[keep]
            else:
                permuted = permuted[keep]


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.astype(np.int64)


def sketches(docs: DataFrame, key: str, text: str, words: int, rows: int, bands: int) -> DataFrame:
    """``(id, n, node, bands)`` per document; ``node`` is a 128-bit digest of the set, null if it is empty."""

    def sketch(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py(), words) for x in batch.column("text")]
            full = [x for x in sets if len(x)]
            keys = band_keys(super_minhash(full, rows * bands), rows, bands) if full else np.empty((0, bands), np.int64)
            there = np.array([len(x) > 0 for x in sets], dtype=bool)
            offsets = np.concatenate([[0], np.cumsum(there * bands)]).astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
                ],
                names=["id", "n", "node", "bands"],
            )

    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return given.mapInArrow(lean(sketch), "id long, n long, node binary, bands array<long>")


def _sets(docs, key, text, words, wanted: DataFrame) -> DataFrame:
    """``(node, items)`` of the wanted ``(id, node)``; found again in the texts, so that none travels but theirs."""

    def shingle(batches):
        for batch in batches:
            for ident, x in zip(batch.column("node"), batch.column("text")):
                items = shingle_set(x.as_py(), words)
                node = xxhash.xxh3_128_digest(items.tobytes())
                if node == ident.as_py():
                    yield pa.record_batch(
                        [pa.array([node], pa.binary()), pa.array([items.astype(np.int64)], pa.list_(pa.int64()))],
                        names=["node", "items"],
                    )

    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    # At scale the ids are too many to broadcast; the hint keeps the plan the same at every size.
    found = given.join(wanted.hint("merge"), "id").mapInArrow(lean(shingle), "node binary, items array<long>")
    # Rows repeated under one id give one set more than once.
    return found.dropDuplicates(["node"])


def _holds(common, n, m, percent: int):
    return F.lit(100) * common >= F.lit(percent) * (n + m - common)


def _can_hold(n, m, percent: int):
    """Sizes alone may rule a pair out."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(one, "a").join(other, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(_holds(common, F.size("x"), F.size("y"), percent)).select("a", "b")


def _search(percent: int):
    """Links between the components that meet in one cell, as few as connect them."""

    def search(cell: pd.DataFrame) -> pd.DataFrame:
        nodes, items = cell["node"].tolist(), cell["items"].tolist()
        _, label = np.unique(cell["root"].to_numpy(), return_inverse=True)
        sizes = np.array([len(x) for x in items])
        ids, code = np.unique(np.concatenate(items), return_inverse=True)
        owner = np.repeat(np.arange(len(items)), sizes)
        links = []
        # The members whose shingles are commonest lead: a copied original connects its copies at once.
        weight = np.bincount(owner, weights=np.bincount(code)[code]) / sizes
        starts = np.cumsum(np.concatenate([[0], sizes]))
        for lead in np.argsort(-weight, kind="stable"):
            open_ = label != label[lead]
            if not open_.any():
                if (label == label[0]).all():
                    break
                continue
            mine = np.zeros(len(ids), dtype=bool)
            mine[code[starts[lead] : starts[lead + 1]]] = True
            common = np.bincount(owner, weights=mine[code], minlength=len(items)).astype(np.int64)
            near = open_ & (100 * common >= percent * (sizes + sizes[lead] - common))
            for other in np.flatnonzero(near):
                if label[other] != label[lead]:
                    links.append((nodes[lead], nodes[other]))
                    label[label == label[other]] = label[lead]
        give_back()
        return pd.DataFrame(links, columns=["a", "b"])

    return search


def _rest(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, part: int) -> DataFrame:
    """Links within buckets whose members, the lead left out, are not in one component yet."""
    placed = members.join(roots, members["node"] == roots["of"], "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("root")
    )
    groups = placed.groupBy("bucket", "root").agg(F.count("*").alias("of_root"))
    several = groups.groupBy("bucket").agg(
        F.count("*").alias("roots"), F.sum(F.when(F.col("of_root") <= part, F.col("of_root")).otherwise(0)).alias("loose")
    ).where("roots > 1")
    sized = groups.join(several, "bucket")
    # A large component has parts of its own, which need not meet each other; the small ones share parts.
    large = F.col("of_root") > part
    parts = F.ceil(F.when(large, F.col("of_root")).otherwise(F.col("loose")) / F.lit(part)).cast("int")
    dealt = stage(
        placed.join(sized.select("bucket", "root", large.alias("large"), parts.alias("parts")), ["bucket", "root"])
        .select("bucket", "node", "root",
                F.when(F.col("large"), F.col("root")).alias("alone"),
                F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int").alias("part")),
        "cells",
    )
    # The members of a part, as far as hashes tell: bands often hold the same members, who need to meet once only.
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1))))
    each = dealt.groupBy("bucket", "alone", "part").agg(mark.alias("mark"))
    p, q = each.alias("p"), each.alias("q")
    name = lambda t: F.struct(F.coalesce(F.col(f"{t}.alone"), F.lit(b"")).alias("alone"), F.col(f"{t}.part").alias("part"))
    apart = ~F.col("p.alone").eqNullSafe(F.col("q.alone")) | F.col("p.alone").isNull()
    cells = p.join(q, (F.col("p.bucket") == F.col("q.bucket")) & (name("p") <= name("q")) & apart).select(
        F.col("p.bucket").alias("bucket"), name("p").alias("one"), name("q").alias("other"),
        F.xxhash64(F.col("p.bucket"), name("p"), name("q")).alias("cell"),
        F.col("p.mark").alias("mark"), F.col("q.mark").alias("other_mark"),
    ).dropDuplicates(["mark", "other_mark"])
    sides = cells.select("bucket", "cell", F.explode(F.array_distinct(F.array("one", "other"))).alias("side"))
    rows = dealt.withColumn("side", F.struct(F.coalesce("alone", F.lit(b"")).alias("alone"), "part"))
    met = rows.join(sides, ["bucket", "side"]).join(sets, "node").select("cell", "node", "root", "items")
    return met.groupBy("cell").applyInPandas(_search(percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 2,
                    percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, part: int = PART, digests: bool = False) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per row of ``docs``; with ``digests`` also ``node``, see :func:`digest`."""
    sketched = stage(sketches(docs, key, text, words, rows, bands), "sketches")
    named = sketched.where("node is not null and id is not null")
    nodes = stage(named.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", "id", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(banded.join(shared, "bucket"), "members")
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    leads = members.join(central, "node").groupBy("bucket").agg(
        F.max(F.struct("weight", F.col("node").alias("a"), F.col("n").alias("m"), F.col("id").alias("i"))).alias("lead")
    )
    # The pairs of a bucket's lead are all examined here; only those of the others may be left.
    led = stage(members.join(leads, "bucket").where(F.col("lead.a") != F.col("node")), "led")
    likely = led.where(_can_hold(F.col("n"), F.col("lead.m"), percent))
    stars = likely.select(F.col("lead.a").alias("a"), F.col("node").alias("b")).distinct()
    wanted = likely.select("id", "node").unionByName(
        likely.select(F.col("lead.i").alias("id"), F.col("lead.a").alias("node"))
    ).unionByName(led.where("size > 2").select("id", "node"))
    sets = stage(_sets(docs, key, text, words, stage(wanted.distinct(), "wanted")), "sets")
    links = stage(_verified(stars, sets, percent), "verified")
    roots = stage(components(links), "roots").select(F.col("node").alias("of"), "root")
    more = stage(_rest(led.select("bucket", "node"), roots, sets, percent, part), "rest")
    if not more.isEmpty():
        roots = stage(components(links.unionByName(more)), "roots").select(F.col("node").alias("of"), "root")
    placed = nodes.select("node", "id").join(roots, nodes["node"] == roots["of"], "left").select(
        "node", "id", F.coalesce("root", "node").alias("root")
    )
    names = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = stage(placed.join(names, "root").select("node", "component_id"), "classes")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return sketched.select("id", "n", "node").join(classes, "node", "left").select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), *["node"] * digests,
    )
