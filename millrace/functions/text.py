"""Text cleaning as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of letters, digits and underscores of any script; the ASCII ones, named first, are
# looked up in a table ...
TOKEN_SEPARATOR = r"[^A-Za-z0-9_\p{L}\p{N}]+"
# ... and tokens of one or two ASCII letters are dropped (the empty one comes from splitting).
DROPPED_TOKEN = r"^[A-Za-z]{0,2}$"


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text in order, short ASCII words dropped. NULL gives NULL."""
    words = F.split(text, TOKEN_SEPARATOR)
    # The pattern is tried on short words only.
    kept = F.filter(words, lambda w: (F.length(w) > 2) | ~w.rlike(DROPPED_TOKEN))
    return F.transform(kept, lambda w: F.lower(w))


def clean(text: Column) -> Column:
    """The tokens joined by single blanks."""
    return F.array_join(tokens(text), " ")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(terms: Column) -> Column:
    """``array<struct<term,tf>>`` of an array of terms, counted inside the row.

    Sorting puts equal terms together, so a term's count is the distance between run starts. A
    document is one row, hence no shuffle is needed to count its terms.
    """

    def run_starts(ordered: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )

    def runs(ordered: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, n: F.struct(
                F.get(ordered, at).alias("term"),
                (F.coalesce(F.get(starts, n + 1), F.size(ordered)) - at).cast("bigint").alias("tf"),
            ),
        )

    counted = bind(
        F.sort_array(terms),
        lambda ordered: bind(run_starts(ordered), lambda starts: runs(ordered, starts)),
    )
    return F.when(F.size(terms) > 0, counted)


def escape_field(text: Column) -> Column:
    """Make a text fit one TSV field: strip, newline and tab to blank, carriage return removed."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.translate(stripped, "\n\t\r", "  ")
