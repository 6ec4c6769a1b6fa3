"""Ranked lexical search over bit-sliced Bloom signatures.

The index has a row per block of documents of similar size. A block's signature is a matrix of bits, a row per Bloom
position and a column per document, so that the documents that may hold a term are the AND of a few rows. Terms
enter once for each of ``LEVELS`` that their number of occurrences reaches: what the rows of a level admit bounds
the occurrences from above. Bits only ever say too much, hence the sum over an item's terms of weight times the
score at that bound is at least the document's score. A block also carries its documents' exact counts, in numbers of
the block's own list of terms, and that list with document frequencies.

A search computes the bounds of all documents for a block of items at once. A task scores the documents with the highest
bounds exactly, then all others whose bound is not below the lowest score that a result can still have; what it skips is
provably no result. Its best few per item meet in one window. Texts are read once, by the index; a search moves no text.

The score of a document is the sum over the item's distinct terms of ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` in
integers, with ``m = 100 - 90 + (90 * n * N) div L`` and ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))``; see ``op13``.

Defined results: null texts and texts without terms have no results, as documents and as items. Documents repeated
under one id count and rank each; equal scores go by ascending id, null ids last. Equal rows of items count once; an id with
several texts has a ranking for each. An empty table on either side gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import lean
from millrace.session import stage

#: Occurrences from which a term enters a signature once more.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024)
BITS, HASHES = 12, 4
#: Signature entries and documents of a block, and entries that a task holds in all, at most but for one document.
ENTRIES, DOCUMENTS, HELD = 1 << 18, 4096, 1 << 20
#: Terms of items that are searched for together, about, and cells of (term, document) that a task bounds at once.
ITEM_TERMS, CELLS = 8192, 1 << 22
NEAREST = 10
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_INDEX = ("documents long, terms_total long, words array<string>, frequencies array<int>, "
          "ids array<long>, lengths array<long>, height int, signature binary, counts binary")


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: maximal runs of ASCII letters and digits, lower-cased, and all characters beyond ASCII."""
    return text.translate(_LETTERS).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def _positions(hashes: np.ndarray, level: np.ndarray | int, height: int) -> np.ndarray:
    """Bloom rows of terms at a level: ``(terms, HASHES)``."""
    x = hashes ^ (np.asarray(level, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(height)).astype(np.int64)


class _Block:
    """Documents of one class of sizes that wait to become a row of the index."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids, self.lengths, self.words, self.tfs = [], [], [], []
        self.entries = 0

    def add(self, name: int | None, length: int, counts: dict[bytes, int], entries: int) -> None:
        place = self.place
        self.ids.append(name)
        self.lengths.append(length)
        self.words.append(np.array([place.setdefault(w, len(place)) for w in counts], dtype=np.int64))
        self.tfs.append(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))
        self.entries += entries

    def row(self) -> list:
        sizes = np.array([len(w) for w in self.words])
        doc, word, tf = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(self.words), np.concatenate(self.tfs)
        order = np.lexsort((word, doc))
        doc, word, tf = doc[order], word[order], tf[order]
        level = np.searchsorted(LEVELS, tf, side="right")
        own = np.bincount(doc, weights=level).max()
        height = max(8, int(BITS * own))
        bits = np.zeros((height, len(sizes)), dtype=bool)
        words = list(self.place)
        hashes = _hashes(words)
        for k in range(len(LEVELS)):
            at = np.flatnonzero(level > k)
            if not len(at):
                break
            bits[_positions(hashes[word[at]], k, height), doc[at][:, None]] = True
        counts = np.concatenate([sizes, word, tf]).astype("<u4").tobytes()
        pack = zstandard.ZstdCompressor(level=1).compress
        return [
            len(sizes), int(sum(self.lengths)), [w.decode("utf-8", "replace") for w in words], np.bincount(word).tolist(),
            self.ids, self.lengths, height, pack(np.packbits(bits, axis=1).tobytes()), pack(counts),
        ]


_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]
_NAMES = [part.split()[0] for part in _INDEX.split(", ")]


def _record(rows: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW)], names=_NAMES)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of ``docs``: a row per block of documents that have terms."""

    def build(batches):
        waiting: dict[int, _Block] = {}
        held = 0
        for batch in batches:
            for name, text_ in zip(batch.column("id"), batch.column("text")):
                found = terms(text_.as_buffer().to_pybytes()) if text_.is_valid else []
                if not found:
                    continue
                counts: dict[bytes, int] = {}
                for w in found:
                    counts[w] = counts.get(w, 0) + 1
                often = np.searchsorted(LEVELS, np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), side="right")
                entries = int(often.sum())
                kind = entries.bit_length()
                block = waiting.setdefault(kind, _Block())
                block.add(name.as_py(), len(found), counts, entries)
                held += entries
                if block.entries >= ENTRIES or len(block.ids) >= DOCUMENTS:
                    held -= block.entries
                    yield _record([waiting.pop(kind).row()])
                elif held >= HELD:
                    largest = max(waiting, key=lambda k: waiting[k].entries)
                    held -= waiting[largest].entries
                    yield _record([waiting.pop(largest).row()])
        for block in waiting.values():
            yield _record([block.row()])

    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return stage(given.mapInArrow(lean(build), _INDEX), "lexical-index")


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Items:
    """Items that are searched for together: pairs of an item and a term, by item."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["item", "digest", "term"], kind="stable", ignore_index=True)
        number = rows.groupby(["item", "digest"], sort=False, dropna=False).ngroup().to_numpy()
        self.starts = np.flatnonzero(np.append(True, np.diff(number) > 0))
        self.sizes = np.diff(np.append(self.starts, len(number)))
        self.names = rows["item"].astype("Int64")[self.starts].tolist()
        self.names = [None if x is pd.NA else int(x) for x in self.names]
        self.digests = rows["digest"].to_numpy()[self.starts]
        self.words, self.word = np.unique(rows["term"].to_numpy(dtype=object), return_inverse=True)
        self.weight = rows["weight"].to_numpy(dtype=np.int64)
        self.hashes = _hashes([w.encode() for w in self.words])


class _Best:
    """The best ``nearest`` documents of each item so far."""

    def __init__(self, items: int, nearest: int):
        self.nearest = nearest
        self.item = self.score = self.id = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)
        self.least = np.ones(items, dtype=np.int64)

    def add(self, item, score, ids, null) -> None:
        good = score >= self.least[item]
        item, score, ids, null = (np.concatenate(x) for x in ((self.item, item[good]), (self.score, score[good]), (self.id, ids[good]), (self.null, null[good])))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        first = np.flatnonzero(np.append(True, np.diff(item) > 0)) if len(item) else item
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        kept = order[place < self.nearest]
        full = order[place == self.nearest - 1]
        self.least[item[place == self.nearest - 1]] = score[full]
        self.item, self.score, self.id, self.null = item[place < self.nearest], score[kept], ids[kept], null[kept]


def _searched(items: _Items, documents: int, total: int, nearest: int):
    def block(row: dict, best: _Best) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        lengths = np.array(row["lengths"], dtype=np.int64)
        many = len(lengths)
        # In Python's integers where a long would not do.
        wide = object if 90 * int(lengths.max()) * documents >= 2**62 else np.int64
        m = (10 + 90 * lengths.astype(wide) * documents // total).astype(np.int64)
        ids = np.array([x or 0 for x in row["ids"]], dtype=np.int64)
        null = np.array([x is None for x in row["ids"]])
        bits = np.frombuffer(unpack(row["signature"]), dtype=np.uint8).reshape(row["height"], -1)
        raw = np.frombuffer(unpack(row["counts"]), dtype="<u4").astype(np.int64)
        sizes, (word, tf) = raw[:many], raw[many:].reshape(2, -1)
        own = pc.index_in(pa.array(items.words, pa.string()), value_set=pa.array(row["words"], pa.string())).fill_null(-1).to_numpy()
        span = len(row["words"]) + 1
        keys = np.repeat(np.arange(many), sizes) * span + word

        def exact(item: np.ndarray, doc: np.ndarray) -> None:
            """Score pairs of an item and a document."""
            step = max(1, CELLS // 8 // int(items.sizes.max()))
            for at in range(0, len(item), step):
                i, d = item[at : at + step], doc[at : at + step]
                n = items.sizes[i]
                ends = np.cumsum(n)
                pair = np.repeat(items.starts[i] - (ends - n), n) + np.arange(ends[-1])
                local = own[items.word[pair]]
                key = np.where(local < 0, -1, np.repeat(d, n) * span + local)
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                count = np.where(keys[place] == key, tf[place], 0)
                part = items.weight[pair] * _impact(count, np.repeat(m[d], n))
                best.add(i, np.add.reduceat(part, ends - n), ids[d], null[d])

        rows = np.arange(len(items.starts))
        step = max(8, CELLS // len(items.word) // 8 * 8)
        for at in range(0, many, step):
            columns = slice(at // 8, (min(many, at + step) + 7) // 8)
            here = np.arange(at, min(many, at + step))
            bound = np.zeros((len(rows), len(here)), dtype=np.int64)
            admitted, before = None, 0
            live = np.arange(len(items.words))
            for k, _ in enumerate(LEVELS):
                hit = np.bitwise_and.reduce(bits[_positions(items.hashes[live], k, row["height"]), columns], axis=1)
                admitted = hit if admitted is None else admitted & hit
                some = admitted.any(axis=1)
                live, admitted = live[some], admitted[some]
                if not len(live):
                    break
                # At most so often: one time less than the next level, or as often as the text has terms.
                most = np.minimum(LEVELS[k + 1] - 1 if k + 1 < len(LEVELS) else lengths[here], lengths[here])
                value = _impact(most, m[here])
                place = np.full(len(items.words), -1)
                place[live] = np.arange(len(live))
                pair = np.flatnonzero(place[items.word] >= 0)
                there = np.unpackbits(admitted, axis=1)[:, : len(here)]
                cells = there[place[items.word[pair]]] * items.weight[pair][:, None]
                item = np.repeat(rows, items.sizes)[pair]
                first = np.flatnonzero(np.append(True, np.diff(item) > 0))
                bound[item[first]] += np.add.reduceat(cells, first, axis=0) * (value - before)
                before = value
            top = min(nearest, len(here))
            high = np.argpartition(-bound, top - 1, axis=1)[:, :top]
            item, doc = np.repeat(rows, top), high.reshape(-1)
            open_ = bound[item, doc] >= best.least[item]
            if open_.any():
                exact(item[open_], here[doc[open_]])
            bound[item, doc] = 0
            item, doc = np.nonzero(bound >= best.least[:, None])
            if len(item):
                exact(item, here[doc])

    def search(batches):
        best = _Best(len(items.starts), nearest)
        for batch in batches:
            for i in range(batch.num_rows):
                block(batch.slice(i, 1).to_pylist()[0], best)
        yield pa.record_batch(
            [
                pa.array([items.names[i] for i in best.item.tolist()], pa.int64()), pa.array(items.digests[best.item], pa.int64()),
                pa.array(best.id, pa.int64(), mask=best.null), pa.array(best.score, pa.int64()),
            ],
            names=["item", "digest", "id", "score"],
        )

    return search


def _item_terms(batches):
    for batch in batches:
        out = []
        for name, text in zip(batch.column("item"), batch.column("text")):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            digest = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
            out += [(name.as_py(), digest, w.decode("utf-8", "replace")) for w in set(terms(raw))]
        columns = list(zip(*out)) or [[]] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string()])], names=["item", "digest", "term"])


def search(blocks: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", nearest: int = NEAREST) -> DataFrame:
    """``(item, rank, id, score)``: the best documents of a stored ``index`` for each row of ``items``."""
    spark = blocks.sparkSession
    sums = blocks.agg(F.sum("documents"), F.sum("terms_total")).first()
    documents, total = sums[0] or 0, sums[1] or 0
    asked = stage(
        items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).distinct()
        .mapInArrow(_item_terms, "item long, digest long, term string"), "item-terms",
    )
    listed = blocks.select(F.explode(F.arrays_zip("words", "frequencies")).alias("x")).select(F.col("x.words").alias("term"), F.col("x.frequencies").alias("df"))
    wanted = asked.select("term").distinct()
    frequency = listed.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln((F.lit(2.0) * documents + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    # A search takes items of about ITEM_TERMS terms at once, which is all that reaches the driver or a task of them.
    groups = max(1, -(-asked.count() // ITEM_TERMS))
    group = F.pmod(F.xxhash64("item", "digest"), F.lit(groups).cast("long"))
    weights = stage(asked.join(frequency, "term").select("item", "digest", "term", weight.alias("weight"), group.alias("group")).where("weight > 0"), "item-weights")
    schema = "item long, digest long, id long, score long"
    found = spark.createDataFrame([], schema)
    for g in range(groups):
        rows = weights.where(F.col("group") == g).drop("group").toPandas()
        if len(rows):
            found = found.unionByName(blocks.mapInArrow(lean(_searched(_Items(rows), documents, total, nearest)), schema))
    order = Window.partitionBy("item", "digest").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("item", "rank", "id", "score")
