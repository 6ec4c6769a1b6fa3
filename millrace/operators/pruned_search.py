"""Top-k search over a stored index that leaves out what cannot be a result.

The index has three tables, all partitioned by ``bucket``, a hash of the term:

* ``postings`` ``(term, block, doc_id, partial_score)``, ordered by term, block and document;
* ``blocks`` ``(term, block, n, most)``: a term's postings per block, their number and the largest partial score;
* ``terms`` ``(term, df, most)``: the dictionary.

A block holds the documents of about one norm. As the norm divides every partial score, blocks of long documents have
low bounds, and a bound per block says much more than one per term.

A query's rarest terms are read first, up to ``first_rows`` postings. The ``k``-th best of their sums is a score that any
result must reach, as other terms only add. Of the other terms, those with the least bounds in a block
are optional there as long as their bounds together do not reach it: a document with only these is no result. The
postings of the rest are read block by block, which raises the score to reach; then optional terms are looked up only for
documents whose sum and whose block's bounds of them still reach it. No result is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.search import SCORE_DECIMALS, top_k
from millrace.operators.tfidf import postings, term_freq, tokenised
from millrace.session import free, new_path, stage, unstage

BUCKETS = 64
#: Blocks per doubling of the norm.
BLOCKS_PER_OCTAVE = 4
#: Postings of a query's rare terms that are read before there is a bound.
FIRST_ROWS = 2_000
#: Scores are compared after rounding; bounds give way by more than rounding and the order of summing can make up.
SLACK = 10.0 ** (1 - SCORE_DECIMALS)


@dataclass(frozen=True)
class Index:
    """The tables of a stored index. Reading one touches only the buckets it is asked for."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    buckets: int

    def within(self, table: DataFrame, buckets: list[int]) -> DataFrame:
        """The part of a table that lies in the buckets; a filter on the partition column, so other files are not opened."""
        return table.where(F.col("bucket").isin(buckets))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(weighted: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store an index of ``weighted`` ``(doc_id, term, tf, df, idf, norm)`` rows, replacing what is there.

    A bucket's postings are dealt to several files by document, as many as the session's shuffle partitions allow, so that a
    term of very many postings is no single task's work. With one bucket rows stay in the task that has them: where
    these hold whole documents, as those of ``tfidf.weights`` do, so do the files, and a search sums a document's scores before
    it shuffles them. That suits an index of which a batch of queries reads every bucket.
    """
    block = F.floor(F.log2("norm") * BLOCKS_PER_OCTAVE).cast("int")
    rows = postings(weighted.withColumn("_block", block), "_block").select(
        bucket_of(F.col("term"), buckets).alias("bucket"), "term", F.col("_block").alias("block"), "doc_id", "partial_score"
    )
    spark = weighted.sparkSession
    order = ["bucket", "term", "block", "doc_id"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def store(table, name, order, dealt_by):
        share = F.pmod(F.xxhash64(dealt_by), F.lit(-(-tasks // buckets)))
        dealt = table if buckets == 1 else table.repartition(tasks, "bucket", share)
        dealt.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        free(spark)  # each table is read back from its files

    store(rows, "postings", order, "doc_id")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    blocks = stored.groupBy("bucket", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("partial_score").alias("most"))
    store(blocks, "blocks", order[:3], "term")
    terms = spark.read.schema(blocks.schema).parquet(f"{path}/blocks").groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    store(terms.withColumn("buckets", F.lit(buckets)), "terms", order[:2], "term")


def dictionary(weighted: DataFrame) -> DataFrame:
    """``(term, df, most, total)``: postings of each term, the largest partial score and their sum, to six decimals."""
    score = lambda of: F.round(of("partial_score"), 6)
    return postings(weighted).groupBy("term").agg(F.count(F.lit(1)).alias("df"), score(F.max).alias("most"), score(F.sum).alias("total"))


def load_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Index:
    """An index stored by :func:`write_index` with as many buckets."""
    read = lambda name, schema: spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{name}")
    keys = read("postings", "term string, block int, doc_id long, partial_score double")
    blocks = read("blocks", "term string, block int, n long, most double")
    return Index(keys, blocks, read("terms", "term string, df long, most double"), buckets)


def _asked(index: Index, queries: DataFrame, query_id: str, query_text: str, first_rows: int) -> tuple[DataFrame, list[int]]:
    """``(query_id, term, query_tf, bucket, rare)`` of the terms that the index knows, and their buckets."""
    terms = term_freq(tokenised(queries, query_id, query_text)).select(
        # In a struct, so that a null id equals itself in joins.
        F.struct(F.col("doc_id").alias("id")).alias("query_id"), "term", F.col("tf").alias("query_tf"), bucket_of(F.col("term"), index.buckets).alias("bucket")
    )
    wanted = stage(terms, "query-terms")
    # At most as many rows as there are buckets.
    buckets = sorted(r[0] for r in wanted.select("bucket").distinct().collect())
    known = wanted.join(index.within(index.terms, buckets).select("bucket", "term", "df"), ["bucket", "term"])
    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    read = F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, 0))
    # Whatever the rarest has, it is read.
    rare = (read <= first_rows) | (F.row_number().over(rarest) == 1)
    asked = stage(known.withColumn("rare", rare).drop("df"), "known-terms")
    unstage(wanted)
    return asked, buckets


def least_results(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, least)``: what a result's score must reach, after ``found`` ``(query_id, doc_id, score)``."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # Queries with fewer documents so far have no score to reach.
    return ranked.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score") - SLACK).otherwise(0.0).alias("least"))


def optional_terms(index: Index, asked: DataFrame, found: DataFrame, k: int, buckets: list[int]) -> DataFrame:
    """``(query_id, bucket, term, query_tf, block, bound, optional)`` of the terms that are not rare, per block.

    ``bound`` is the sum of bounds of the terms up to this one, least first.
    """
    frequent = asked.where(~F.col("rare")).drop("rare")
    terms = frequent.join(index.within(index.blocks, buckets), ["bucket", "term"])
    ordered = Window.partitionBy("query_id", "block").orderBy(F.col("most") * F.col("query_tf"), "term")
    bound = F.sum(F.col("most") * F.col("query_tf")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    summed = terms.select("query_id", "bucket", "term", "query_tf", "block", bound.alias("bound"))
    optional = F.col("bound") < F.coalesce("least", F.lit(0.0))
    return summed.join(least_results(found, k), "query_id", "left").withColumn("optional", optional).drop("least")


def _added(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    part = F.col("partial_score") * F.col("query_tf")
    return rows.join(wanted, on).select("query_id", "block", "doc_id", part.alias("score"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "doc_id").agg(F.first("block").alias("block"), F.sum("score").alias("score"))


def looked_up(rows: DataFrame, found: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """``(query_id, block, doc_id, score)``: optional terms of the documents of ``found`` that can still be results."""
    optional = terms.where("optional").drop("optional")
    bounds = optional.groupBy("query_id", "block").agg(F.max("bound").alias("bound"))
    live = found.join(bounds, ["query_id", "block"]).join(least_results(found, k), "query_id").where(
        F.col("score") + F.col("bound") >= F.col("least")
    )
    wanted = live.select("query_id", "block", F.struct("doc_id").alias("doc")).join(optional.drop("bound"), ["query_id", "block"])
    return _added(rows.withColumn("doc", F.struct("doc_id")), wanted.drop("block"), ["bucket", "term", "doc"])


def search_index(index: Index, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "text",
                 first_rows: int = FIRST_ROWS) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the same rows as the exhaustive search over the same postings."""
    asked, buckets = _asked(index, queries, query_id, query_text, first_rows)
    rows = index.within(index.postings, buckets)
    first = stage(_summed(_added(rows, asked.where("rare").drop("rare"), ["bucket", "term"])), "rare-scores")
    free(first.sparkSession)
    terms = stage(optional_terms(index, asked, first, k, buckets), "optional-terms")
    needed = terms.where("not optional").drop("bound", "optional")
    found = stage(_summed(first.unionByName(_added(rows, needed, ["bucket", "term", "block"]))), "found-scores")
    unstage(asked, first)
    scored = found.unionByName(looked_up(rows, found, terms, k)).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return top_k(scored, k).select(F.col("query_id.id").alias("query_id"), "rank", "doc_id", "score")


def search_corpus(weighted: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "text",
                  buckets: int = 1) -> DataFrame:
    """Search ``weighted`` rows through an index stored for this one search, which is read as a whole."""
    path = new_path(weighted.sparkSession, "index")
    write_index(weighted, path, buckets)
    return search_index(load_index(weighted.sparkSession, path, buckets), queries, k, query_id, query_text)
