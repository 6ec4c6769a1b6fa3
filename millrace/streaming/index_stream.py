"""An index of a corpus that keeps growing: term rows in segments, document frequencies as stream state.

Arriving documents are tokenised once. Their ``(doc_id, term, tf)`` rows are appended as a segment per micro-batch, and a
stateful count per term keeps document frequencies: a batch writes only the terms whose count changed, so
the frequencies of the corpus are the largest count of each term. Weights depend on the
corpus as a whole and are made from segments and frequencies when an index is wanted, without reading a text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.tfidf import term_freq, tokenised, weights_of

#: The row that counts documents; no token is empty.
ALL = ""


def grow(spark: SparkSession, arriving: str, schema: T.StructType | str, store: str, id_col: str = "doc_id",
         text_col: str = "text", glob: str = "*.parquet") -> None:
    """Take in every file of documents that has arrived and not been taken in, then stop.

    Both streams write a batch to a folder of its own, which is replaced if the batch runs again after a failure, so
    each document counts once. ``store`` holds segments, frequencies, state and progress.
    """
    documents = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(arriving)
    tokens = tokenised(documents, id_col, text_col)

    def append(name):
        return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{store}/{name}/batch={batch}")

    once = tokens.select(F.explode(F.concat(F.array(F.lit(ALL)), F.array_distinct("terms"))).alias("term"))
    counts = once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for name, rows, mode in (("segments", term_freq(tokens), "append"), ("frequencies", counts, "update")):
        run = rows.writeStream.outputMode(mode).foreachBatch(append(name)).option("checkpointLocation", f"{store}/progress/{name}")
        run.trigger(availableNow=True).start().awaitTermination()


def frequencies(spark: SparkSession, store: str) -> DataFrame:
    """``(term, df)`` of all documents so far; the row of the term ``ALL`` counts documents."""
    return spark.read.parquet(f"{store}/frequencies").groupBy("term").agg(F.max("df").alias("df"))


def grown_weights(spark: SparkSession, store: str) -> DataFrame:
    """``(doc_id, term, tf, df, idf, norm)`` of all documents so far, as ``weights`` makes of the whole corpus."""
    known = frequencies(spark, store)
    documents = known.where(F.col("term") == ALL).select("df").scalar()
    rows = spark.read.parquet(f"{store}/segments").drop("batch")
    return weights_of(rows, known.where(F.col("term") != ALL), documents)
