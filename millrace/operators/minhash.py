"""MinHash signatures and banded locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import hashing, vectors
from millrace.functions.arrays import hashed_texts, least_seeded
from millrace.operators.skew import attach, pairs_within
from millrace.session import stage


def signatures(
    docs: DataFrame,
    num_hashes: int = 90,
    k: int = 10,
    seed: int = 1,
    keep: list[str] = ["id"],
) -> DataFrame:
    """``(keep..., sig)``: per seeded hash the minimum over a text's shingles, hashed by ``hashing.base_hash``.

    A text is hashed in the task that reads it, with its neighbours as arrays, and is one signature from then on. Signatures
    of rows that are equal in ``keep`` are joined; ``keep`` is the id and whatever depends on it alone.
    """
    members = hashing.family(num_hashes, seed)
    given = docs.select(*keep, F.col("text").alias("_text"))

    def sign(batches):
        for batch in batches:
            texts = batch.column("_text")
            for rows, values, counts in hashed_texts(texts, k):
                full = np.flatnonzero(counts)
                least = least_seeded(values, counts[full], members).astype(np.int32)
                ends = pa.array(np.arange(len(full) + 1, dtype=np.int32) * num_hashes)
                sig = pa.ListArray.from_arrays(ends, pa.array(least.reshape(-1)))
                chosen = batch.drop_columns(["_text"]).take(pa.array(rows.start + full))
                yield pa.record_batch([*chosen.columns, sig], names=[*keep, "sig"])

    schema = T.StructType([*given.select(*keep).schema.fields, T.StructField("sig", T.ArrayType(T.IntegerType()))])
    least = [F.min(F.get("sig", F.lit(i))) for i in range(num_hashes)]
    mins = given.mapInArrow(sign, schema).groupBy(*keep).agg(*[m.alias(f"_m{i}") for i, m in enumerate(least)])
    return mins.select(*keep, F.array(*[F.col(f"_m{i}") for i in range(num_hashes)]).alias("sig"))


def band_keys(sig: Column, r: int, b: int) -> Column:
    """The bucket keys of a signature's ``b`` bands of ``r`` entries, in band order.

    A signature shorter than ``r * b`` ends the job: its missing bands would all be equal.
    """
    if r < 1 or b < 1:
        raise ValueError(f"bands need r >= 1 and b >= 1, not r = {r} and b = {b}")
    short = F.concat(F.lit(f"{r} * {b} hashes are needed, a signature has "), F.size(sig).cast("string"))
    sig = F.when(F.size(sig) >= r * b, sig).otherwise(F.raise_error(short).cast("array<int>"))
    return F.array(
        *[
            hashing.digest60(F.array_join(vectors.block(sig, band, r).cast("array<string>"), ","))
            for band in range(b)
        ]
    )


def bands(sigs: DataFrame, r: int = 10, b: int = 9) -> DataFrame:
    """``(id, band, bucket)``, one row per band."""
    return sigs.select("id", F.posexplode(band_keys(F.col("sig"), r, b)).alias("band", "bucket"))


def bucket_sizes(banded: DataFrame) -> DataFrame:
    """``(band, bucket, n)``."""
    return banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"))


def signature_classes(sigs: DataFrame) -> DataFrame:
    """``(id, first)``: each signature with the smallest id that has an equal one; a star, one row per signature.

    Signatures are compared by a 128-bit digest, so that no signature moves.
    """
    keyed = sigs.select("id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("_digest"))
    firsts = keyed.groupBy("_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("_n"))
    return attach(keyed, firsts, ["_digest"], row_id="id", freq="_n").select("id", "first")


def candidate_pairs(narrow: DataFrame) -> DataFrame:
    """``(id1, id2)``: pairs of ids that share a bucket of ``bands``, each once.

    Most buckets hold one document: they are counted and leave. Nothing but ids and keys moves.
    """
    shared = bucket_sizes(narrow).where(F.col("n") > 1)
    live = attach(narrow, shared, ["band", "bucket"], row_id="id", freq="n")
    met = pairs_within(live, ["band", "bucket"], "id", "n", [], lambda one, other: F.lit(True))
    return met.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")).distinct()


def lsh_classes(sigs: DataFrame, r: int = 10, b: int = 9, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id1, id2, score)`` between the first ids of different signatures, and ``(id, first)`` of all signatures.

    ``score`` is the share of equal hashes; with a ``threshold`` only pairs scoring at least that much remain. A group of equal
    signatures takes part as one, so its size does not matter for the pairs. Store the signatures first
    (``stage``), they are read several times.
    """
    members = stage(signature_classes(sigs), "signature-classes")
    narrow = bands(sigs.join(members.where(F.col("id") == F.col("first")).select("id"), "id", "left_semi"), r, b)
    pairs = candidate_pairs(narrow)
    side = lambda id_, sig: sigs.select(F.col("id").alias(id_), F.slice("sig", 1, r * b).alias(sig))
    score = vectors.equal_share(F.col("_one"), F.col("_other"))
    scored = pairs.join(side("id1", "_one"), "id1").join(side("id2", "_other"), "id2").select("id1", "id2", score.alias("score"))
    return (scored if threshold is None else scored.where(F.col("score") >= F.lit(threshold))), members


def lsh_pairs(
    sigs: DataFrame,
    r: int = 10,
    b: int = 9,
    threshold: float | None = None,
) -> DataFrame:
    """``(id1, id2, score)``: all pairs that share a bucket, ``score`` their share of equal hashes.

    :func:`lsh_classes` with its stars written out: as many rows as there are pairs. Give signatures of distinct
    texts, for which equal signatures are few.
    """
    pairs, members = lsh_classes(sigs, r, b, threshold)
    several = members.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    grouped = attach(members, several, ["first"], row_id="id", freq="n")
    equal = pairs_within(grouped, ["first"], "id", "n", [], lambda one, other: F.lit(True)).select(
        F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), F.lit(1.0).alias("score")
    )
    one, other = (members.select(F.col("id").alias(f"_m{i}"), F.col("first").alias(f"id{i}")) for i in (1, 2))
    between = pairs.join(one, "id1").join(other, "id2").select(
        F.least("_m1", "_m2").alias("id1"), F.greatest("_m1", "_m2").alias("id2"), "score"
    )
    return between.unionByName(equal)
