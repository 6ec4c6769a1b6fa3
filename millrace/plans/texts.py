"""Term statistics and search over ``documents``, with ``benchmark`` as query texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import pruned_search, tfidf
from millrace.operators import search as se
from millrace.session import new_path, spread
from millrace.sources.sinks import write_readable_index
from millrace.sources.tables import table
from millrace.streaming.index_stream import grow, grown_weights
from millrace.streaming.search_stream import answer_stream

TOP = 10
FIELDS = ["lang", "source", "n_chars", "text"]


def _tokens(spark, folder):
    documents = table(spark, folder, "documents", "doc_id", "text")
    return tfidf.tokenised(spread(documents, "doc_id"), "doc_id", "text")


def _queries(spark, folder):
    return table(spark, folder, "benchmark", "item_id", "text").withColumnRenamed("item_id", "query_id")


def tokens(spark, folder):
    rows = tfidf.token_rows(_tokens(spark, folder))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def doc_freq(spark, folder):
    return tfidf.doc_freq(_tokens(spark, folder))


def term_freq(spark, folder):
    return tfidf.term_freq(_tokens(spark, folder))


def tfidf_weights(spark, folder):
    weighted = tfidf.weights(_tokens(spark, folder))
    return weighted.select(
        "doc_id", "term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("norm", 6).alias("norm")
    )


def postings(spark, folder):
    built = tfidf.postings(tfidf.weights(_tokens(spark, folder)))
    return built.select("term", "doc_id", F.round("partial_score", 6).alias("partial_score"))


def _found(spark, folder):
    found = pruned_search.search_corpus(tfidf.weights(_tokens(spark, folder)), _queries(spark, folder), TOP)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


def search_topk(spark, folder):
    return _found(spark, folder)


def search_hydrate(spark, folder):
    return se.hydrate(_found(spark, folder), table(spark, folder, "documents"), "doc_id", FIELDS)


def search_stream(spark, folder):
    """The query table arrives as a stream of files; the index is stored and loaded."""
    base = new_path(spark, "search-stream")
    # One bucket: the arriving table asks for terms of all.
    pruned_search.write_index(tfidf.weights(_tokens(spark, folder)), f"{base}/index", buckets=1)
    answer_stream(
        spark,
        # A pattern, which finds the table stored as one file or as a folder of part files.
        arriving=f"{folder}/benchmark.parque[t]",
        schema=table(spark, folder, "benchmark").schema,
        index=pruned_search.load_index(spark, f"{base}/index", buckets=1),
        answers=f"{base}/answers",
        progress=f"{base}/progress",
        k=TOP,
        query_id="item_id",
    )
    answered = spark.read.parquet(f"{base}/answers")
    return answered.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


def index_growth(spark, folder):
    """The documents arrive in three loads; what the index is made of afterwards."""
    base = new_path(spark, "index-growth")
    documents = table(spark, folder, "documents", "doc_id", "text")
    for load in range(3):
        documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == load).write.mode("append").parquet(f"{base}/arriving")
        grow(spark, f"{base}/arriving", documents.schema, f"{base}/store")
    return pruned_search.dictionary(grown_weights(spark, f"{base}/store"))


def readable_index(spark, folder):
    """The index as text lines in order of terms, read back."""
    path = new_path(spark, "readable")
    write_readable_index(tfidf.postings(tfidf.weights(_tokens(spark, folder))), path)
    parts = F.split("value", "\t", 2)
    entries = F.from_json(F.get(parts, F.lit(1)), "array<struct<doc_id:bigint,partial_score:double>>")
    lines = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("term"), entries.alias("entries"))
    total = F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["partial_score"])
    return lines.groupBy("term").agg(
        F.sum(F.size("entries")).alias("df"), F.min(F.col("entries")[0]["doc_id"]).alias("first_doc"), F.round(F.sum(total), 6).alias("total")
    )


QUERIES = {
    "tokens": tokens,
    "doc_freq": doc_freq,
    "term_freq": term_freq,
    "tfidf_weights": tfidf_weights,
    "postings": postings,
    "search_topk": search_topk,
    "search_hydrate": search_hydrate,
    "search_stream": search_stream,
    "index_growth": index_growth,
    "readable_index": readable_index,
}


def token_list(text: str) -> str:
    """SQL for the token list of a text column."""
    return (
        rf"list_transform(list_filter(string_split_regex({text}, '[^\p{{L}}\p{{N}}_]+'), "
        r"lambda w: NOT regexp_matches(w, '^[A-Za-z]{0,2}$')), lambda w: lower(w))"
    )


_TOKENS = f"tok AS (SELECT doc_id, {token_list('text')} AS terms FROM documents)"
_STATS = f"""{_TOKENS},
        tf AS (SELECT doc_id, term, count(*) AS tf
               FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
_WEIGHTS = f"""{_STATS},
        i AS (SELECT doc_id, tf.term, tf, df,
                     log10((SELECT count(*) FROM documents)::DOUBLE / df) AS idf
              FROM tf JOIN df ON tf.term = df.term),
        w AS (SELECT *, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id)) AS norm FROM i),
        p AS (SELECT term, doc_id, tf * idf * idf / norm AS partial_score FROM w WHERE norm > 0)"""
_FOUND = f"""{_WEIGHTS},
        q AS (SELECT query_id, term, count(*) AS query_tf
              FROM (SELECT item_id AS query_id, unnest({token_list('text')}) AS term FROM benchmark)
              GROUP BY 1, 2),
        s AS (SELECT query_id, doc_id, round(sum(partial_score * query_tf), 9) AS score
              FROM q JOIN p ON q.term = p.term GROUP BY 1, 2),
        found AS (SELECT query_id, row_number() OVER (PARTITION BY query_id
                         ORDER BY score DESC, doc_id DESC) AS rank, doc_id, score FROM s
                  QUALIFY rank <= {TOP})"""

ORACLE = {
    "tokens": f"""
        WITH {_TOKENS}
        SELECT doc_id, unnest(range(len(terms))) AS pos, unnest(terms) AS term FROM tok""",
    "doc_freq": f"WITH {_STATS} SELECT term, df FROM df",
    "term_freq": f"WITH {_STATS} SELECT doc_id, term, tf FROM tf",
    "tfidf_weights": f"""
        WITH {_WEIGHTS}
        SELECT doc_id, term, tf, df, round(idf, 6) AS idf, round(norm, 6) AS norm FROM w""",
    "postings": f"""
        WITH {_WEIGHTS}
        SELECT term, doc_id, round(partial_score, 6) AS partial_score FROM p""",
    "search_topk": f"WITH {_FOUND} SELECT query_id, rank, doc_id, score FROM found",
    "search_hydrate": f"""
        WITH {_FOUND}
        SELECT f.doc_id, f.query_id, f.rank, f.score, {', '.join('d.' + c for c in FIELDS)},
               f.doc_id + 1 AS line
        FROM found f JOIN documents d ON f.doc_id = d.doc_id""",
    "search_stream": f"WITH {_FOUND} SELECT query_id, rank, doc_id, score FROM found",
    "index_growth": f"""
        WITH {_WEIGHTS}
        SELECT term, count(*) AS df, round(max(partial_score), 6) AS most, round(sum(partial_score), 6) AS total
        FROM p GROUP BY term""",
    "readable_index": f"""
        WITH {_WEIGHTS}
        SELECT term, count(*) AS df, min(doc_id) AS first_doc, round(sum(partial_score), 6) AS total FROM p GROUP BY term""",
}
