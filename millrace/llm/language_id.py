"""Language identification by prediction by partial matching (PPM) over bytes.

Training counts, per language, which byte follows each context of up to three bytes. The counts are then
frozen. A text is coded under every language: at each byte the longest context known to the language codes
the byte if it was seen there (count / (n + d), with n occurrences of the context and d distinct successors);
otherwise an escape of probability d / (n + d) is coded and the next shorter context is tried, down to the
uniform code of 1/256. The language with the shortest code wins.

Training reads at most ``SAMPLE_DOCS`` documents of each label, those with the smallest hash of id and text; equal rows
count once. Counting is a Spark aggregation; what reaches the driver is the model, all contexts of up to
three bytes in the sampled documents. A worker holds them as sorted lists per language, so a language with few or
multi-byte texts keeps every context whatever the others have. Prediction is one pass over the texts without a shuffle, in which
each distinct run of four bytes of a chunk is priced once.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the first label in
code-point order; an empty or unlabelled training set makes every text ``und``. Rows keep all their other
columns, and repeated rows are predicted alike.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import sole_cache

#: Documents sampled for each label.
SAMPLE_DOCS = 400
ORDER = 3
#: Bytes coded at a time; bounds a task's memory however long a text is.
CHUNK = 1 << 19
UNDETERMINED = "und"
HAS_LETTER = r"\p{L}"
SCORED = "lang_pred string, score double, bits_per_byte double"

_TABLES: dict[str, tuple] = {}


def _grams(text: str) -> np.ndarray:
    """Each byte with its three predecessors, as one number; line feeds stand before the text."""
    b = np.frombuffer(b"\n" * ORDER + text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def _count(batches):
    for batch in batches:
        for label, rows in batch.groupby("label", sort=False):
            for text in rows["text"]:
                grams, counts = np.unique(_grams(text), return_counts=True)
                if len(grams):
                    yield pd.DataFrame({"label": label, "gram": grams.astype(np.int64), "n": counts.astype(np.int64)})


def train(labelled: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id",
          sample_docs: int = SAMPLE_DOCS) -> dict:
    """Frozen counts of the labelled rows; see the module for the bounds."""
    usable = labelled.select(F.col(label).alias("label"), F.col(text).alias("text"), F.col(key).alias("id")).where(
        F.col("label").isNotNull() & F.col("text").isNotNull()
    ).withColumn("hash", F.xxhash64("id", "text"))
    distinct = usable.select("label", "hash").distinct()
    counts = distinct.groupBy("label").count().collect()  # one row per language
    if not counts:
        return {"id": uuid.uuid4().hex, "labels": []}
    # A draw by hash passes about four times the sample of a large label, so that few rows are ranked.
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], 4.0 * sample_docs / r["count"])])
    draw = F.pmod("hash", F.lit(1 << 31)) / F.lit(float(1 << 31))
    drawn = usable.where(draw < limits[F.col("label")]).groupBy("label", "hash").agg(F.min("text").alias("text"))
    order = Window.partitionBy("label").orderBy(draw, "hash")
    sample = drawn.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample_docs).select("label", "text")
    rows = (
        sample.mapInPandas(_count, "label string, gram long, n long")
        .groupBy("label", "gram").agg(F.sum("n").alias("n"))
        .orderBy("label", "gram").toPandas()
    )
    labels = sorted(rows["label"].unique())
    return {
        "id": uuid.uuid4().hex,
        "labels": labels,
        "label": rows["label"].map({x: i for i, x in enumerate(labels)}).to_numpy(np.int32),
        "gram": rows["gram"].to_numpy(np.int64),
        "n": rows["n"].to_numpy(np.int64),
    }


def _orders(gram: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Per order, longest first: runs of context and byte with their bits, and contexts with the bits of an escape."""
    out = []
    for order in range(ORDER, -1, -1):
        runs, where = np.unique(gram & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
        count = np.bincount(where, weights=n, minlength=len(runs))
        contexts, of = np.unique(runs >> 8, return_inverse=True)
        total, distinct = np.bincount(of, weights=count), np.bincount(of)
        out.append((runs, -np.log2(count / (total + distinct)[of]), contexts, -np.log2(distinct / (total + distinct))))
    return out


def _tables(model: dict) -> list[list[tuple]]:
    """The orders of each language."""
    sole_cache("language", _TABLES)
    if model["id"] not in _TABLES:
        _TABLES.clear()
        _TABLES[model["id"]] = [_orders(model["gram"][own], model["n"][own]) for own in (model["label"] == i for i in range(len(model["labels"])))]
    return _TABLES[model["id"]]


def _held(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted ``keys`` have the wanted ones, and which of these they have."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _priced(orders: list[tuple], grams: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each run of four, after the other three, under one language."""
    bits = np.full(len(grams), 8.0)
    open_ = np.arange(len(grams))
    escaped = np.zeros(len(grams))
    for order, (runs, seen, contexts, escape) in zip(range(ORDER, -1, -1), orders):
        key = grams[open_] & ((1 << (8 * (order + 1))) - 1)
        at, hit = _held(runs, key)
        bits[open_[hit]] = seen[at[hit]]
        open_, key = open_[~hit], key[~hit]
        at, known = _held(contexts, key >> 8)
        escaped[open_[known]] += escape[at[known]]
    return bits + escaped


def code_lengths(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text under each language, and its bytes."""
    tables = _tables(model)
    coded = [x.encode("utf-8", "surrogatepass") for x in texts]
    lengths = np.array([len(x) for x in coded], dtype=np.int64)
    found = np.zeros((len(coded), len(tables)))
    first = 0
    while first < len(coded):
        last, room = first, 0
        while last < len(coded) and (last == first or room + lengths[last] <= CHUNK):
            room += lengths[last]
            last += 1
        found[first:last] = _code(coded[first:last], tables)
        first = last
    return found, lengths


def _code(coded: list[bytes], tables: list[list[tuple]]) -> np.ndarray:
    pad = b"\n" * ORDER
    whole = np.frombuffer(b"".join(pad + x for x in coded), dtype=np.uint8)
    sizes = np.array([len(x) + ORDER for x in coded])
    doc = np.repeat(np.arange(len(coded), dtype=np.int32), sizes)
    coding = np.ones(len(whole), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(ORDER):
        coding[starts + k] = False
    found = np.zeros((len(coded), len(tables)))
    for at in range(ORDER, len(whole), CHUNK):
        b = whole[at - ORDER : at + CHUNK].astype(np.uint32)
        use = coding[at : at + CHUNK]
        grams, where = np.unique(((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])[use], return_inverse=True)
        grams, of = grams.astype(np.int64), doc[at : at + CHUNK][use]
        for i, orders in enumerate(tables):
            found[:, i] += np.bincount(of, weights=_priced(orders, grams)[where], minlength=len(coded))
    return found


def predicted(model: dict, text: Column) -> Column:
    """A struct column ``lang_pred, score, bits_per_byte`` for a text column."""
    labels = model["labels"]

    @F.pandas_udf(SCORED)
    def code(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": UNDETERMINED, "score": 0.0, "bits_per_byte": 0.0}, index=texts.index)
        use = texts.notna().to_numpy() & bool(labels)
        if use.any():
            found, lengths = code_lengths(model, list(texts[use]))
            best = found.argmin(axis=1)
            least = found[np.arange(len(best)), best]
            share = 1 / np.exp2(np.clip(least[:, None] - found, -1000, 0)).sum(axis=1)
            out.loc[use, "lang_pred"] = [labels[i] for i in best]
            out.loc[use, "score"] = np.round(share, 6)
            out.loc[use, "bits_per_byte"] = least / np.maximum(lengths, 1)
        return out

    with_letter = F.when(text.rlike(HAS_LETTER), text)
    return code(with_letter)


def held_out(key: Column) -> Column:
    """A fifth of the ids, by checksum; a null id is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, model: dict, text: str = "text", column: str = "language") -> DataFrame:
    """``docs`` with one more struct column, the prediction, instead of any of that name."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != column], predicted(model, F.col(text)).alias(column))
