"""Character k-shingles of texts, and the collapsing of equal texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as tx
from millrace.functions.arrays import hashed_texts
from millrace.operators.skew import attach

# Four bytes hold any character, so the i-th one starts at byte 4*i and a shingle is a plain byte
# range. On UTF-8 each substring would scan the text from its start.
FIXED_WIDTH = "UTF-32"
WIDTH = 4


def shingle_rows(docs: DataFrame, k: int = 10, keep: list[str] = ["id"]) -> DataFrame:
    """``(keep..., shingle)``, one row per text position, repeats included.

    Texts shorter than ``k`` (or NULL) have none. Explode and substring stay in one generated
    stage, with no array of shingles in memory.
    """
    wide = docs.select(
        *keep, F.encode("text", FIXED_WIDTH).alias("_wide"), F.length("text").alias("_n")
    )
    starts = F.when(F.col("_n") >= k, F.sequence(F.lit(0), F.col("_n") - k))
    rows = wide.select(*keep, "_wide", F.explode_outer(starts).alias("_at"))
    # Filter on the position, not on the text: Spark would push a text filter down to the scan and
    # clean every text a second time for it. For the same reason explode_outer stands above.
    rows = rows.where(F.col("_at").isNotNull())
    piece = F.substring(F.col("_wide"), F.col("_at") * WIDTH + 1, F.lit(k * WIDTH))
    return rows.select(*keep, F.decode(piece, FIXED_WIDTH).alias("shingle"))


def shingle_hashes(text: Column, k: int = 10) -> Column:
    """The distinct 64-bit hashes of a text's shingles as an array, computed inside the row.

    The text is encoded once; each shingle is a byte range of it.
    """

    def hashes(wide: Column) -> Column:
        last = (F.octet_length(wide) / WIDTH).cast("int") - k
        positions = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            positions, lambda at: F.xxhash64(F.substring(wide, at * WIDTH + 1, F.lit(k * WIDTH)))
        )

    return F.array_distinct(tx.bind(F.encode(text, FIXED_WIDTH), hashes))


def _in_row(text: Column, k: int, of) -> Column:
    """The distinct values of ``of(shingle)`` for a text's shingles, computed inside the row."""

    def values(wide: Column) -> Column:
        last = (F.octet_length(wide) / WIDTH).cast("int") - k
        positions = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            positions, lambda at: of(F.decode(F.substring(wide, at * WIDTH + 1, F.lit(k * WIDTH)), FIXED_WIDTH))
        )

    return F.array_distinct(tx.bind(F.encode(text, FIXED_WIDTH), values))


def shingle_sets(docs: DataFrame, k: int = 10) -> DataFrame:
    """``(id, shingle)`` without repeats, one row per document and shingle; no shuffle."""
    return docs.select("id", F.explode(_in_row(F.col("text"), k, lambda s: s)).alias("shingle"))


def hashed_shingles(docs: DataFrame, k: int = 10) -> DataFrame:
    """``(id, hashes)``: the distinct ``hashing.base_hash`` values of a text's shingles as an array; no shuffle."""

    def find(batches):
        for batch in batches:
            for rows, values, counts in hashed_texts(batch.column("text"), k):
                sets = [np.unique(x) for x in np.split(values, np.cumsum(counts)[:-1])]
                ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).astype(np.int64)))
                yield pa.record_batch([batch.column("id")[rows], hashes], names=["id", "hashes"])

    given = docs.select("id", "text")
    schema = T.StructType([given.schema["id"], T.StructField("hashes", T.ArrayType(T.LongType()))])
    return given.mapInArrow(find, schema)


def cleaned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` with the text cleaned as for search."""
    return docs.select(F.col(id_col).alias("id"), tx.clean(F.col(text_col)).alias("text"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``(id, text, copies)``: equal texts collapse to the smallest id.

    Pair operators work on these rows. A group of m copies would make m(m-1)/2 pairs that say
    nothing but "equal"; here it is one row, and copies combine before the shuffle.
    """
    grouped = docs.groupBy("text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    return grouped.select("id", "text", "copies")


def copy_links(docs: DataFrame) -> DataFrame:
    """``(id, copy_id)``: every further document of an equal text, linked to the smallest id.

    A star per text, one row per copy. Texts are compared by digest; a text that very many
    documents share is one hot key, which :func:`attach` spreads.
    """
    keyed = docs.select(F.col("id").alias("copy_id"), F.md5("text").alias("_text"))
    first = keyed.groupBy("_text").agg(F.min("copy_id").alias("id"), F.count(F.lit(1)).alias("_n"))
    shared = first.where(F.col("_n") > 1)
    linked = attach(keyed, shared, ["_text"], row_id="copy_id", freq="_n")
    return linked.where(F.col("copy_id") > F.col("id")).select("id", "copy_id")
