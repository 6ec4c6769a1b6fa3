"""Term statistics, TF-IDF weights and postings of a corpus ``(id, text...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators.skew import attach


def tokenised(corpus: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """``(id, terms)``: the tokens of all text columns of a row, in column order."""
    parts = [tx.tokens(F.coalesce(F.col(c), F.lit(""))) for c in text_cols]
    terms = F.concat(*parts) if len(parts) > 1 else parts[0]
    return corpus.select(F.col(id_col).alias("doc_id"), terms.alias("terms"))


def token_rows(tokens: DataFrame) -> DataFrame:
    """``(doc_id, pos, term)``, one row per token, positions from 0."""
    return tokens.select("doc_id", F.posexplode("terms").alias("pos", "term"))


def term_freq(tokens: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)``. Counted inside each row, so there is no shuffle."""
    # The outer form: for the plain one Spark derives a filter that evaluates the array once more.
    counted = tokens.select("doc_id", F.inline_outer(tx.term_counts(F.col("terms"))))
    return counted.where(F.col("term").isNotNull())


def doc_freq(tokens: DataFrame) -> DataFrame:
    """``(term, df)``: documents that contain the term, each counted once."""
    once = tokens.select(F.explode_outer(F.array_distinct("terms")).alias("term"))
    return once.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def weights(tokens: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, df, idf, norm)`` with ``idf = log10(N / df)`` and the document's norm.

    Two passes over the tokens: document frequencies, then weights.
    """
    n_docs = tokens.select(F.count(F.lit(1))).scalar()
    return weights_of(term_freq(tokens), doc_freq(tokens), n_docs)


def weights_of(rows: DataFrame, frequencies: DataFrame, n_docs: Column) -> DataFrame:
    """:func:`weights` from ``(doc_id, term, tf)`` rows, ``(term, df)`` and the number of documents.

    A frequent term's rows are spread by :func:`attach`. The second shuffle, by document, gives every
    window the terms of one document only.
    """
    joined = attach(rows, frequencies, ["term"], row_id="doc_id", freq="df")
    # Counts travel to their document; what follows from them is wider and is computed there.
    joined = joined.select("doc_id", "term", "tf", "df").repartition("doc_id")
    idf = F.log10(n_docs.cast("double") / F.col("df"))
    by_doc = Window.partitionBy("doc_id")
    weighted = joined.withColumn("idf", idf).withColumn("_w", F.col("tf") * F.col("idf"))
    return weighted.select(
        "doc_id",
        "term",
        "tf",
        "df",
        "idf",
        F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(by_doc)).alias("norm"),
    )


def postings(weighted: DataFrame, *keep: str) -> DataFrame:
    """``(term, doc_id, df, partial_score, keep...)`` with ``tf * idf^2 / norm``: the query-independent part.

    A document whose terms all occur everywhere has norm 0 and gets no postings.
    """
    score = F.col("tf") * F.col("idf") * F.col("idf") / F.col("norm")
    return weighted.where(F.col("norm") > 0).select(
        "term", "doc_id", "df", score.alias("partial_score"), *keep
    )


def build_postings(corpus: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """Postings straight from a corpus table."""
    return postings(weights(tokenised(corpus, id_col, *text_cols)))
