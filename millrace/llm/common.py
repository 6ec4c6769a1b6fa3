"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A standard table, read by Spark only, so that any store Spark knows will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with signs added until ``docs`` has no column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty. The native regular expression engine does the work."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions of the session: sized by whoever runs the job."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` with the given lengths; an empty run sums to 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


_CACHES: dict[str, dict] = {}


def sole_cache(name: str, cache: dict) -> None:
    """Empty what other operators remember in this Python worker, which Spark uses again for later stages.

    What an operator remembers only saves time; in a pipeline the sum of it would outgrow a worker's memory.
    """
    _CACHES[name] = cache
    for other, held in _CACHES.items():
        if other != name and held is not cache:
            held.clear()


def give_back() -> None:
    """Return freed memory to the system. Spark keeps Python workers for later stages, and an idle one would hold on to it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function for ``mapInArrow`` or ``mapInPandas`` that ends with :func:`give_back`."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped
