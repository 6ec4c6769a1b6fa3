"""Quality rules: text statistics, fixed base rules, and robust multivariate outliers per language and source.

A text's statistics are transformed to five numbers (``FEATURES``). Their ordinary location and spread are estimated
for each language and source, each language and all rows by the minimum covariance determinant: of all ``KEPT`` shares
of the rows, the one whose covariance has the least determinant. From each of ``STARTS`` concentration steps are repeated, which
keep the share of rows nearest by Mahalanobis distance and take their mean and covariance, until the determinant
stops falling; the start that ends with the least determinant wins. A text is rejected if its squared distance, with the
estimate of the finest group that has one, exceeds ``CUT``. The ``MOST_GROUPS`` largest groups of at least ``LEAST_ROWS`` rows have
one, and all rows together, however few they are.

Every step is two passes over all rows, whose partial results are a few dozen numbers per group and the counts of a
histogram of distances, ``BINS`` bins to an octave, from which the cut comes; no group is collected and none is
joined by its key. Counts are exact, sums of the same rows in another order may differ in their last digits.

Statistics that are nearly constant in ordinary text would make the covariance singular; ``FLOORS`` is the least
standard deviation that counts for each. Only excess of signs and repetition is unusual, not their absence: those
features are 0 where the statistic is.

Defined results: a null text has no words and fails the base rules; null languages and sources are groups of their
own; repeated rows are judged alike; an empty table gives no rows. All other columns stay.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import sole_cache
from millrace.llm.minhash_dedup import mixed
from millrace.session import stage

LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["length", "word_length", "symbols", "dup_lines", "repeats"]
FLOORS = [0.8, 0.12, 0.35, 0.6, 0.8]
KEPT, STEPS, LEAST_ROWS, MOST_GROUPS = 0.75, 30, 200, 5_000
#: Medians with quartiles, all rows, and the rows between the outer eighths of every feature.
STARTS = ("quartiles", "all", "middle")
BINS = 1024
#: Consistency at the normal distribution of a covariance from the nearest 75 % of rows in five dimensions.
CONSISTENT = 1.414
#: Squared distances of ordinary rows exceed this with probability 1e-6 (chi-squared, five degrees of freedom).
CUT = 35.9

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_MEMO: dict[str, int] = {}
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """``STATISTICS`` of one text."""
    text = text or ""
    words = _SPLIT.findall(text)
    symbols = len(_SYMBOLS.findall(text))
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif _SPLIT.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), symbols, duplicates, _repeated(words)


def _repeated(words: list[str]) -> int:
    """Words that lie in a window of five words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    sole_cache("quality", _MEMO)
    if len(_MEMO) > 400_000:
        _MEMO.clear()
    code = np.fromiter((_MEMO.setdefault(w, len(_MEMO)) for w in words), dtype=np.uint64, count=len(words))
    key = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + code[i : n + i] + np.uint64(1))
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[where] > 1)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measured(text: Column) -> Column:
    """``STATISTICS`` of a text column, as a struct."""

    @F.pandas_udf(", ".join(f"{x} long" for x in STATISTICS))
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = [statistics(x if isinstance(x, str) else None) for x in texts]
        return pd.DataFrame(rows, columns=STATISTICS, index=texts.index, dtype=np.int64)

    return measure(text)


def base_failed(s: Column) -> Column:
    """The fixed rules: too few words, or too many of them repeated."""
    return (s["n_words"] < LEAST_WORDS) | (F.lit(100) * s["n_repeat_words"] > F.lit(REPEAT_PERCENT) * s["n_words"])


def features(s: Column) -> Column:
    """``FEATURES`` as an array; logarithms, in which counts of ordinary texts spread evenly."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    share = lambda x: F.log1p(F.lit(100.0) * x / words)
    # The mean length of few words varies by chance; shrink it as its standard error grows.
    certain = words / (words + 30)
    return F.array(
        F.log(words), F.log(F.greatest(s["word_chars"], F.lit(1)) / words / 5.0) * certain,
        share(s["n_symbols"]), share(s["n_dup_lines"]), share(s["n_repeat_words"]),
    )


def _squared(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances of rows."""
    z = x - mean
    return np.einsum("ni,ij,nj->n", z, inverse, z)


def _bin(distance: np.ndarray) -> np.ndarray:
    """A number that never falls with the distance."""
    return np.floor(np.log2(np.maximum(distance, 1e-12)) * BINS).astype(np.int64)


def _each(batch: pa.RecordBatch, known):
    """``(group, rows of x)`` for every group of the batch that is ``known``, on each of the three levels."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    names = batch.column("groups").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    for level in range(names.shape[1]):
        codes, groups = pd.factorize(names[:, level])
        order = np.argsort(codes, kind="stable")
        for code, rows in enumerate(np.split(order, np.cumsum(np.bincount(codes, minlength=len(groups)))[:-1])):
            if groups[code] in known:
                yield groups[code], flat[rows]


def _histograms(rows: DataFrame, states: dict[tuple[str, str], tuple]) -> dict[tuple[str, str], int]:
    """The bin up to which the nearest ``KEPT`` of the rows lie, per group and start."""
    by_group: dict[str, list] = {}
    for (group, start), state in states.items():
        by_group.setdefault(group, []).append((start, state))

    def count(batches):
        totals: dict[tuple, int] = {}
        for batch in batches:
            for group, x in _each(batch, by_group):
                for start, (mean, inverse, _) in by_group[group]:
                    bins, counts = np.unique(_bin(_squared(x, mean, inverse)), return_counts=True)
                    for at, n in zip(bins.tolist(), counts.tolist()):
                        totals[group, start, at] = totals.get((group, start, at), 0) + n
        yield _table(totals, ["group", "start", "bin"], [pa.string(), pa.string(), pa.int64()], ["n"], pa.int64())

    counted = rows.mapInArrow(count, "group string, start string, bin long, n long").groupBy("group", "start", "bin").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("group", "start")
    upto = F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    enough = counted.select("group", "start", "bin", upto.alias("upto"), F.sum("n").over(of).alias("rows")).where(F.col("upto") >= F.ceil(F.col("rows") * KEPT))
    return {(r["group"], r["start"]): r["bin"] for r in enough.groupBy("group", "start").agg(F.min("bin").alias("bin")).collect()}


def _moments(rows: DataFrame, wanted) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance per group and start; ``wanted(group)`` lists ``(start, centre, mask of rows)``."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    names = ["n", *[f"s{i}" for i in range(d)], *[f"s{i}_{j}" for i, j in pairs]]
    centres = {k: c for k, c, _ in wanted}
    by_group: dict[str, list] = {}
    for (group, start), centre, mask in wanted:
        by_group.setdefault(group, []).append((start, centre, mask))

    def add(batches):
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for group, x in _each(batch, by_group):
                for start, centre, mask in by_group[group]:
                    z = x[mask(x)] - centre
                    second = z.T @ z
                    own = np.array([len(z), *z.sum(axis=0), *[second[i, j] for i, j in pairs]])
                    totals[group, start] = totals.get((group, start), 0) + own
        yield _table(totals, ["group", "start"], [pa.string(), pa.string()], names, pa.float64())

    schema = "group string, start string, " + ", ".join(f"{x} double" for x in names)
    out = {}
    for r in rows.mapInArrow(add, schema).groupBy("group", "start").agg(*[F.sum(x).alias(x) for x in names]).collect():
        part = np.array([r[f"s{i}"] for i in range(d)]) / max(r["n"], 1)
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"s{i}_{j}"] / max(r["n"], 1)
        out[r["group"], r["start"]] = (centres[r["group"], r["start"]] + part, second - np.outer(part, part))
    return out


def _table(totals: dict, keys: list[str], kinds: list, names: list[str], kind) -> pa.RecordBatch:
    columns = list(zip(*totals)) or [[]] * len(keys)
    values = np.array([np.atleast_1d(v) for v in totals.values()]).reshape(len(totals), len(names))
    return pa.record_batch(
        [*[pa.array(c, t) for c, t in zip(columns, kinds)], *[pa.array(values[:, i], kind) for i in range(len(names))]], names=[*keys, *names]
    )


def _state(mean: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse and determinant of a covariance with the floors added to its diagonal."""
    floored = covariance + np.diag(np.square(FLOORS))
    return mean, np.linalg.inv(floored), float(np.linalg.det(floored))


def _within(state: tuple, cut: int):
    return lambda x: _bin(_squared(x, state[0], state[1])) <= cut


def _between(low: np.ndarray, high: np.ndarray):
    return lambda x: ((low <= x) & (x <= high)).all(axis=1)


def estimates(rows: DataFrame, steps: int = STEPS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and inverse covariance per group of ``rows`` ``(groups, x)``; at most ``MOST_GROUPS`` of them and ``all``."""
    d = len(FEATURES)
    sizes = rows.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n"))
    large = sizes.where((F.col("n") >= LEAST_ROWS) & (F.col("group") != ALL)).orderBy(F.desc("n"), "group").limit(MOST_GROUPS)
    known = [ALL, *[r["group"] for r in large.collect()]]
    own = rows.select(F.explode("groups").alias("group"), "x").where(F.col("group").isin(known))
    shares = own.groupBy("group").agg(*[
        F.percentile_approx(F.col("x")[i], [0.125, 0.25, 0.5, 0.75, 0.875], 10_000).alias(f"q{i}") for i in range(d)
    ]).collect()
    quantiles = {r["group"]: np.array([r[f"q{i}"] for i in range(d)]) for r in shares}
    states, done = {}, {}
    wanted = []
    for group, q in quantiles.items():
        spread = np.square((q[:, 3] - q[:, 1]) / 1.349)
        states[group, "quartiles"] = _state(q[:, 2], np.diag(spread))
        wanted += [((group, "all"), q[:, 2], _between(np.full(d, -np.inf), np.full(d, np.inf))), ((group, "middle"), q[:, 2], _between(q[:, 0], q[:, 4]))]
    for key, (mean, covariance) in _moments(rows, wanted).items():
        states[key] = _state(mean, covariance)
    last = dict.fromkeys(states, np.inf)
    for _ in range(steps):
        if not states:
            break
        cuts = _histograms(rows, states)
        wanted = [(key, state[0], _within(state, cuts[key])) for key, state in states.items()]
        found = {key: _state(mean, CONSISTENT * covariance) for key, (mean, covariance) in _moments(rows, wanted).items()}
        falls = {key: state[2] < last[key] * (1 - 1e-9) for key, state in found.items()}
        done |= {key: state for key, state in found.items() if falls[key]}
        last |= {key: state[2] for key, state in found.items() if falls[key]}
        states = {key: state for key, state in found.items() if falls[key]}
    best: dict[str, tuple] = {}
    for (group, start), state in sorted(done.items()):
        if group not in best or state[2] < best[group][2]:
            best[group] = state
    return {group: state[:2] for group, state in best.items()}


def distances(found: dict[str, tuple[np.ndarray, np.ndarray]], groups: Column, x: Column) -> Column:
    """Squared distance of each row by the estimate of its finest group that has one."""

    @F.pandas_udf(T.DoubleType())
    def measure(names: pd.Series, rows: pd.Series) -> pd.Series:
        own = np.array([next((g for g in n if g in found), "") for n in names], dtype=object)
        out = np.zeros(len(own))
        flat = np.array(rows.tolist(), dtype=float).reshape(len(own), -1)
        for group in set(own) - {""}:
            here = own == group
            out[here] = _squared(flat[here], *found[group])
        return pd.Series(out, index=names.index)

    return measure(groups, x)


#: The group of all rows.
ALL = "all"


def _groups(lang: Column, source: Column) -> list[Column]:
    """Group names from fine to coarse; lengths in them keep different pairs apart."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?"))
    return [F.concat(F.length(text(lang)).cast("string"), text(lang), text(source)), F.concat(F.lit("lang"), text(lang)), F.lit(ALL)]


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cut: float = CUT,
           column: str = "quality") -> DataFrame:
    """``docs`` with a struct: ``STATISTICS``, ``base_failed``, ``distance`` and ``kept``.

    Texts are read once; their statistics are written to the shared folder with the columns of ``docs`` but the text,
    so pass only the columns that are wanted. A column of the name of ``column`` is replaced.
    """
    columns = [c for c in docs.columns if c != text]
    groups = _groups(F.col(lang), F.col(source))
    given = docs.select(
        F.struct(*[F.col(c) for c in columns]).alias("row"), F.array(*groups).alias("groups"), measured(F.col(text)).alias("s")
    ).withColumn("x", features(F.col("s")))
    rows = stage(given, "statistics")
    found = estimates(rows.select("groups", "x"))
    distance = distances(found, F.col("groups"), F.col("x")).alias("distance")
    placed = rows.select("row", "s", distance)
    failed = base_failed(F.col("s"))
    verdict = F.struct(
        *[F.col("s")[x].alias(x) for x in STATISTICS], failed.alias("base_failed"),
        "distance", (~failed & (F.col("distance") <= cut)).alias("kept"),
    )
    return placed.select(*[F.col("row").getField(c).alias(c) for c in columns if c != column], verdict.alias(column))
