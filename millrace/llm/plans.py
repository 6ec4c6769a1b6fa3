"""Registered queries of this subpackage over the standard tables, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import language_id, lexical_search, license_scan, minhash_dedup, mixing, packing, passages, quality, secret_scan, sentence_pieces, token_files, vector_graph, whitening
from millrace.llm.common import WORD, documents
from millrace.llm.tokens import tokenizer_path

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op3_language_id(spark, folder):
    docs = documents(spark, folder)
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op4_minhash_dedup(spark, folder):
    found = minhash_dedup.near_duplicates(documents(spark, folder))
    return found.withColumnRenamed("id", "doc_id")


def op1_license_scan(spark, folder):
    return license_scan.licenses(documents(spark, folder).select("doc_id", "text"))


def op2_packing(spark, folder):
    return packing.packed(documents(spark, folder), tokenizer_path(), with_ids=False)


def op5_passages(spark, folder):
    return passages.shared_passages(documents(spark, folder))


def op6_secret_scan(spark, folder):
    found = secret_scan.scan(documents(spark, folder).select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(secret_scan.BASE))
    of_kind = lambda i: F.size(F.filter("secrets", lambda s: s["rank"] == i)).cast("bigint")
    return found.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("secrets")).alias("spans"),
    )


def op7_quality(spark, folder):
    found = quality.judged(documents(spark, folder).select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", *[f"quality.{x}" for x in [*quality.STATISTICS, "base_failed", "kept"]])


def op8_mixing(spark, folder):
    return mixing.taken(documents(spark, folder)).withColumnRenamed("id", "doc_id")


def op9_token_files(spark, folder):
    files = token_files.write_files(documents(spark, folder), tokenizer_path())
    return token_files.read_files(files, with_ids=False)


def op10_vector_graph(spark, folder):
    table = documents(spark, folder, "embeddings")
    return vector_graph.nearest_neighbours(table, vector_graph.index_queries(table))


def op11_whitening(spark, folder):
    return whitening.whitened(documents(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_sentence_pieces(spark, folder):
    path = tokenizer_path("piece_bpe_32k.model")
    ids = sentence_pieces.encoded(documents(spark, folder).select("doc_id", "text"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return sentence_pieces.decoded(ids, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op13_lexical_search(spark, folder):
    found = lexical_search.search(lexical_search.index(documents(spark, folder)), documents(spark, folder, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_passages": op5_passages,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_token_files": op9_token_files,
    "op10_vector_graph": op10_vector_graph,
    "op11_whitening": op11_whitening,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE = {
    "op4_minhash_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
        x AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE
                list_sort(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) END AS x FROM w),
        node AS (SELECT x, min(doc_id) AS id, len(x) AS n FROM x WHERE len(x) > 0 GROUP BY x),
        item AS (SELECT id, n, unnest(x) AS s FROM node),
        link AS (SELECT a.id AS a, b.id AS b FROM item a JOIN item b
                 ON a.s = b.s AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
                 GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT id AS a, id AS b FROM node UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
        class AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT x.doc_id, len(x.x)::BIGINT AS n_shingles, coalesce(c.component_id, x.doc_id) AS component_id,
               x.doc_id = coalesce(c.component_id, x.doc_id) AS kept
        FROM x LEFT JOIN node USING (x) LEFT JOIN class c ON c.id = node.id""",
    "op13_lexical_search": f"""
        WITH word AS (
            SELECT doc_id, row_number() OVER () AS doc,
                   regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS words FROM documents),
        doc AS (SELECT doc_id, doc, words, len(words) AS n FROM word WHERE len(words) > 0),
        total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM doc),
        asked AS (SELECT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}'))) AS term
                  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        posting AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(words) AS term FROM doc)
                    WHERE term IN (SELECT term FROM asked) GROUP BY doc, term),
        weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
                   FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), total),
        scored AS (SELECT a.item_id, a.text, d.doc_id, d.doc,
                          sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
                   FROM asked a JOIN weight USING (term) JOIN posting p USING (term) JOIN doc d ON d.doc = p.doc, total
                   GROUP BY a.item_id, a.text, d.doc_id, d.doc),
        ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank,
                          doc_id, score FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
