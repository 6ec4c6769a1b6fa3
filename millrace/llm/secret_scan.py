"""Secrets in texts: patterns, and a battery of randomness tests with false-discovery control. Native expressions only.

Base kinds are patterns; see ``BASE``. The method adds kind ``random``: long runs of characters that look drawn at
random from the alphabet of their encoding (hex, base32, base64). Ordinary text is the null hypothesis: its
characters repeat unevenly, it seldom changes between lower case, upper case and digits, and neighbours
depend on each other. Three statistics of a run are compared with what the null hypothesis gives at its length:

* chi-squared distance from a uniform alphabet, which grows with the length for ordinary text and does not for
  random characters;
* the number of runs of one character class;
* the correlation of neighbouring character codes.

Their scores add up to one p-value per candidate (Stouffer). Candidates are grouped by encoding and by the
logarithm of their length, as short ones carry little evidence, and in each group Benjamini-Hochberg's step-up
rule bounds the share of false discoveries by ``RATE``. The rule needs only a histogram of p-values per group, a few
hundred rows however large the corpus is; its cut points become literals, and the texts are read again to apply
them, so that nothing is joined or shuffled but the histogram. A random run that overlaps a base span is not
listed again.

Positions count code points, ends are exclusive. Defined results: a null text counts as empty; no rows of ``docs``
leave; repeated rows are treated alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds: pattern, group that has a least length, that length.
BASE = {
    "assign": (r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
               r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What may be a secret of an unknown form. An '=' only pads the end, so that the value of ``name=value`` stands alone.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}=*"
#: Alphabets by rising size: pattern and number of characters.
ENCODINGS = [("hex", "^[0-9a-fA-F]+$", 16), ("base32", "^[A-Z2-7]+=*$", 32), ("base64", "^[A-Za-z0-9+/_-]+=*$", 64)]
#: Share of false discoveries in each group of candidates.
RATE = 0.001
#: Least number of letters and digits of a candidate: below it even uniform characters say too little.
LEAST = 20
#: Sum of squared letter shares of ordinary text, and its standard deviation for one word of 20 letters.
ORDINARY_SHARE, ORDINARY_SPREAD = 0.075, 0.018
#: Changes of character class per character of ordinary text.
ORDINARY_CHANGES = 0.06
#: p-values are counted in this many steps per power of ten, down to 10^-DECADES.
STEPS, DECADES = 4, 16


_SPANS = "array<struct<start:int,end:int,value:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """``array<struct<start,end,value>>`` of the leftmost matches; ``value`` is a group, filtered by its length.

    The pieces between matches and the matches themselves add up to the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.arrays_zip(between.alias("gap"), F.transform(found, F.length).alias("size"), values.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        kept = x["size"].isNotNull() & (F.length(x["value"]) >= least)
        item = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(kept, F.concat(state["out"], F.array(item))).otherwise(state["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(sizes, empty, step, lambda s: s["out"])).otherwise(_none())


def base_spans(text: Column) -> dict[str, Column]:
    """One span array per base kind."""
    quick = {
        # A run that is long enough, or the cheap part of a pattern, rules most texts out.
        "assign": text.rlike("[:=]"),
        "access": text.contains("AKIA"),
        "hex": text.rlike("[0-9a-f]{24}"),
    }
    # Runs of 24 and more are the same matches as all runs with the short ones dropped.
    patterns = BASE | {"hex": (r"[0-9a-f]{24,}", 0, 24)}
    return {
        kind: F.when(quick[kind], spans(text, pattern, group, least)).otherwise(_none())
        for kind, (pattern, group, least) in patterns.items()
    }


def _encoding(value: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern, _ in reversed(ENCODINGS):
        found = F.when(value.rlike(pattern), name).otherwise(found)
    return found


def normal_tail(z: Column) -> Column:
    """P(Z > z) by a rational approximation of the error function (relative error below 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.5) * x)
    # Fixed values of the approximation.
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
             0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    series = reduce(lambda rest, c: F.lit(c) + t * rest, reversed(terms[:-1]), F.lit(terms[-1]))
    tail = t * F.exp(series - x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _bounded(z: Column, most: float = 6.0) -> Column:
    return F.greatest(F.least(z, F.lit(most)), F.lit(-6.0))


def battery(value: Column) -> Column:
    """``struct<encoding,n,chi_squared,changes,serial,p>`` of a run of characters.

    ``p`` is the probability that ordinary text looks as random. Signs between letters and digits are left out.
    """
    kind = lambda c: F.when(c < 58, 0).when(c < 91, 1).otherwise(2)  # noqa: E731  digits, upper, lower case

    def tests(codes: Column) -> Column:
        n = F.size(codes).cast("double")
        encoding = _encoding(value)
        size = reduce(lambda rest, e: F.when(encoding == e[0], float(e[2])).otherwise(rest), ENCODINGS, F.lit(64.0))
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(codes, lambda d: d == c)).cast("double"), F.lit(2.0)))
        share = (squares - n) / (n * (n - 1))
        pairs = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("a"), F.slice(codes, 2, F.size(codes) - 1).alias("b"))
        changes = F.aggregate(pairs, F.lit(0), lambda a, x: a + F.when(kind(x["a"]) != kind(x["b"]), 1).otherwise(0))
        mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n

        def serial_of(m):
            covariance = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + (x["a"] - m) * (x["b"] - m))
            variance = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - m) * (c - m))
            return F.when(variance > 0, covariance / variance).otherwise(1.0)

        raw = F.struct(encoding.alias("encoding"), size.alias("size"), n.alias("n"), share.alias("share"),
                       changes.alias("changes"), _let(mean, serial_of).alias("serial"))

        def scored(r):
            # A small alphabet makes ordinary text repeat itself more.
            ordinary = F.lit(ORDINARY_SHARE) + F.when(r["size"] <= 16, 1.2 / r["size"]).otherwise(0.0)
            uniform = (ordinary - r["share"]) / (F.lit(ORDINARY_SPREAD) * F.sqrt(F.lit(20.0) / r["n"]))
            expected = r["n"] * ORDINARY_CHANGES
            runs = (r["changes"] - expected) / F.sqrt(expected * (1 - ORDINARY_CHANGES))
            independent = 1 - F.abs(r["serial"]) * F.sqrt(r["n"]) / 2
            z = (_bounded(uniform) + _bounded(runs) + _bounded(independent)) / F.sqrt(F.lit(3.0))
            return F.struct(
                r["encoding"].alias("encoding"), r["n"].cast("int").alias("n"),
                ((r["size"] * r["share"] - 1) * (r["n"] - 1) + r["size"] - 1).alias("chi_squared"),
                r["changes"].alias("changes"), r["serial"].alias("serial"), normal_tail(z).alias("p"),
            )

        return _let(raw, scored)

    body = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    codes = F.transform(F.split(body, ""), lambda c: F.ascii(c).cast("double"))
    return F.when(F.length(body) >= LEAST, _let(codes, tests))


def _band(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _step(p: Column) -> Column:
    return F.least(F.greatest(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS), F.lit(0)), F.lit(STEPS * DECADES)).cast("int")


def cut_points(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[tuple[str, int], int]:
    """Per (encoding, length band) the least step of the histogram that is a discovery.

    The driver gets one row per cell of the histogram, at most 3 encodings x 31 bands x 65 steps.
    """
    values = docs.where(F.col(text).rlike(CANDIDATE)).select(
        F.explode(F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0))).alias("value")
    )
    tested = values.select(battery(F.col("value")).alias("t")).where("t.encoding is not null")
    cells = tested.groupBy(
        F.col("t.encoding").alias("encoding"), _band(F.col("t.n")).alias("band"), _step(F.col("t.p")).alias("step")
    ).agg(F.count("*").alias("n")).collect()
    groups: dict[tuple[str, int], dict[int, int]] = {}
    for cell in cells:
        groups.setdefault((cell["encoding"], cell["band"]), {})[cell["step"]] = cell["n"]
    cuts = {}
    for group, counts in groups.items():
        total, rank = sum(counts.values()), 0
        for step in sorted(counts, reverse=True):
            rank += counts[step]
            if 10.0 ** (-step / STEPS) <= rate * rank / total:
                cuts[group] = step
    return cuts


def random_spans(text: Column, cuts: dict[tuple[str, int], int]) -> Column:
    """Spans of the discoveries."""
    if not cuts:
        return _none()

    def found(s):
        def passes(t):
            ok = F.lit(False)
            for (encoding, band), step in sorted(cuts.items()):
                ok = F.when((t["encoding"] == encoding) & (_band(t["n"]) == band), _step(t["p"]) >= step).otherwise(ok)
            return F.coalesce(ok, F.lit(False))

        return _let(battery(s["value"]), passes)

    return F.filter(spans(text, CANDIDATE), found)


def scan(docs: DataFrame, text: str = "text", column: str = "secrets", rate: float = RATE) -> DataFrame:
    """``docs`` with one more column: an array of ``struct<start,rank,end,kind>`` in this order.

    ``rank`` is 0 to 2 for the base kinds and 3 for ``random``.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    cuts = cut_points(docs, text, rate)

    def named(found, rank, kind):
        return F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.concat(*[named(x, i, kind) for i, (kind, x) in enumerate(base_spans(whole).items())])

    def with_random(listed):
        more = named(random_spans(whole, cuts), len(BASE), "random")
        apart = F.filter(more, lambda s: ~F.exists(listed, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
        return F.array_sort(F.concat(listed, apart))

    return docs.select("*", _let(base, with_random).alias(column))


def redacted(text: Column, secrets: Column, mark: str = "[secret]") -> Column:
    """The text with every listed span replaced; overlapping spans are replaced together."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    rest = F.aggregate(secrets, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(secrets) > 0, rest).otherwise(text)


def joined(secrets: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
