"""Search for query texts that keep arriving as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.operators.pruned_search import Index, search_index


def answer_stream(
    spark: SparkSession,
    arriving: str,
    schema: T.StructType | str,
    index: Index,
    answers: str,
    progress: str,
    k: int = 10,
    query_id: str = "query_id",
    query_text: str = "text",
    glob: str = "*.parquet",
) -> None:
    """Answer every query file that has arrived and not been answered, then stop.

    Each micro-batch is a batch search. Ranking needs a window, which a stream cannot have, a batch
    inside ``foreachBatch`` can. A batch writes to a folder of its own and replaces it if it is run
    again after a failure, so each query is answered once. ``progress`` must outlive the job. A batch reads the
    buckets of its terms: their part of the dictionary, of the bounds and of the postings.
    """

    def answer(queries: DataFrame, batch: int) -> None:
        found = search_index(index, queries, k, query_id, query_text)
        found.write.mode("overwrite").parquet(f"{answers}/batch={batch}")

    queries = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(arriving)
    run = (
        queries.writeStream.foreachBatch(answer)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
