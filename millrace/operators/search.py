"""Batch top-k search of query texts over postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import ROWS_PER_PART, part_of, parts_of
from millrace.operators.tfidf import doc_freq, postings, term_freq, tokenised, weights
from millrace.session import stage

# Scores are summed in no fixed order; ranking on nine decimals makes equal documents tie.
SCORE_DECIMALS = 9


def scores(
    index: DataFrame,
    queries: DataFrame,
    query_id: str = "query_id",
    query_text: str = "text",
    stats: DataFrame | None = None,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """``(query_id, doc_id, score)`` for every document sharing a term with the query.

    A term's postings are cut into parts by the document frequency they carry, and the query's
    term row is repeated per part; unknown query terms find no posting and drop out. ``stats`` is
    ``(term, df)``; pass it when postings are not stored, to save computing them a second time.
    """
    asked = term_freq(tokenised(queries, query_id, query_text)).select(
        F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("query_tf")
    )
    parts = parts_of(F.col("df"), rows_per_part)
    cut = index.withColumn("_part", part_of(F.col("doc_id"), parts))
    if stats is None:
        stats = index.groupBy("term").agg(F.max("df").alias("df"))
    frequent = stats.where(F.col("df") > rows_per_part).select("term", parts.alias("_parts"))
    repeated = asked.join(frequent, "term", "left").select(
        "query_id",
        "term",
        "query_tf",
        F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"),
    )
    met = cut.join(repeated, ["term", "_part"])
    return met.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("partial_score") * F.col("query_tf")).alias("score")
    )


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of each query, by score and then by larger id, with their rank.

    The rank limit is applied within each task before the shuffle as well.
    """
    rounded = scored.withColumn("score", F.round("score", SCORE_DECIMALS))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    ranked = rounded.withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= k)


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    query_id: str = "query_id",
    query_text: str = "text",
    stats: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, rank, doc_id, score)``."""
    found = top_k(scores(index, queries, query_id, query_text, stats), k)
    return found.select("query_id", "rank", "doc_id", "score")


def search_corpus(
    tokens: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "text"
) -> DataFrame:
    """Search without a stored index, over ``(doc_id, terms)`` rows."""
    index = postings(weights(tokens))
    return search(index, queries, k, query_id, query_text, stats=doc_freq(tokens))


def hydrate(found: DataFrame, corpus: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Add the documents' own fields and ``line``, their line in a file with one header line.

    What was found is at most ``k`` rows per query; it is stored first, so that its size is known when the
    join is planned: below the session's broadcast threshold no document is shuffled.
    """
    stored = corpus.select(F.col(id_col).alias("doc_id"), *fields)
    return stage(found, "found").join(stored, "doc_id").withColumn("line", F.col("doc_id") + 1)
