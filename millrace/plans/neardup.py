"""Near-duplicate queries over ``documents``.

Pairs are pairs of distinct texts, each named by its smallest document id; ``text_copies`` links a
text's other documents to it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.operators import jaccard, minhash, quality
from millrace.operators import shingles as sh
from millrace.plans.texts import token_list
from millrace.session import spread, stage
from millrace.sources.tables import table

K, R, B, T = 10, 10, 9, 0.8
SETTINGS = [(10, 9), (12, 7)]
HASHES = R * B


def _cleaned(spark, folder):
    documents = table(spark, folder, "documents", "doc_id", "text")
    return sh.cleaned(spread(documents, "doc_id"), "doc_id", "text")


def _texts(spark, folder):
    """Distinct cleaned texts, stored: whatever a query derives from them, ``documents`` is read once."""
    return stage(sh.distinct_texts(_cleaned(spark, folder)), "texts")


def _signatures(texts):
    return stage(minhash.signatures(texts, HASHES, K), "signatures")


def shingles(spark, folder):
    return sh.shingle_sets(_cleaned(spark, folder), K)


def shingle_hash(spark, folder):
    hashed = sh.hashed_shingles(_cleaned(spark, folder), K)
    total = F.aggregate("hashes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return hashed.where(F.size("hashes") > 0).select(
        "id", F.size("hashes").cast("bigint").alias("n"), F.array_min("hashes").alias("least"),
        F.array_max("hashes").alias("most"), total.alias("total"),
    )


def minhash_sig(spark, folder):
    sigs = minhash.signatures(_cleaned(spark, folder), HASHES, K)
    return sigs.select("id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


def _bands(spark, folder):
    return minhash.bands(minhash.signatures(_cleaned(spark, folder), HASHES, K), R, B)


def lsh_bands(spark, folder):
    return _bands(spark, folder).withColumn("band", F.col("band").cast("bigint"))


def lsh_bucket_sizes(spark, folder):
    sizes = minhash.bucket_sizes(_bands(spark, folder))
    return sizes.withColumn("band", F.col("band").cast("bigint"))


def text_copies(spark, folder):
    return sh.copy_links(_cleaned(spark, folder))


def lsh_candidates(spark, folder):
    return minhash.lsh_pairs(_signatures(_texts(spark, folder)), R, B)


def lsh_pairs(spark, folder):
    return minhash.lsh_pairs(_signatures(_texts(spark, folder)), R, B, T)


def jaccard_pairs(spark, folder):
    return jaccard.jaccard_pairs(_texts(spark, folder), T, K)


def similar_documents(spark, folder):
    """For the documents in ``labels``: every document similar to them, copies included."""
    ids = table(spark, folder, "labels", "doc_id").select(F.col("doc_id").alias("id"))
    return quality.partners(jaccard_pairs(spark, folder), text_copies(spark, folder), ids)


def pairs_intersect(spark, folder):
    texts = _texts(spark, folder)
    return quality.common_pairs(jaccard.jaccard_pairs(texts, T, K), minhash.lsh_pairs(_signatures(texts), R, B, T))


def lsh_quality(spark, folder):
    texts = _texts(spark, folder)
    return quality.pair_quality(
        jaccard.jaccard_pairs(texts, T, K), minhash.lsh_pairs(_signatures(texts), R, B, T), quality.copy_weights(texts, K)
    )


def banding_sweep(spark, folder):
    texts = _texts(spark, folder)
    exact = stage(jaccard.jaccard_pairs(texts, T, K), "exact-pairs")
    weights = quality.copy_weights(texts, K)
    sigs = _signatures(texts)
    rows = None
    for r, b in SETTINGS:
        measured = quality.pair_quality(exact, minhash.lsh_pairs(sigs, r, b), weights)
        row = measured.select(F.lit(r).cast("bigint").alias("r"), F.lit(b).cast("bigint").alias("b"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


QUERIES = {
    "shingles": shingles,
    "shingle_hash": shingle_hash,
    "minhash_sig": minhash_sig,
    "lsh_bands": lsh_bands,
    "lsh_bucket_sizes": lsh_bucket_sizes,
    "text_copies": text_copies,
    "lsh_candidates": lsh_candidates,
    "lsh_pairs": lsh_pairs,
    "jaccard_pairs": jaccard_pairs,
    "similar_documents": similar_documents,
    "pairs_intersect": pairs_intersect,
    "lsh_quality": lsh_quality,
    "banding_sweep": banding_sweep,
}

_CLEAN = f"c AS (SELECT doc_id AS id, array_to_string({token_list('text')}, ' ') AS text FROM documents)"


def _shingled(source: str) -> str:
    return f"""sh AS (SELECT DISTINCT id, substr(text, i::BIGINT, {K}) AS s
                      FROM (SELECT id, text, unnest(range(1, length(text) - {K} + 2)) AS i
                            FROM {source} WHERE length(text) >= {K}))"""


_TEXTS = f"{_CLEAN}, t AS (SELECT min(id) AS id, text, count(*) AS copies FROM c GROUP BY text)"
_X = f"x AS (SELECT DISTINCT id, ('0x' || substr(md5(s), 1, 8))::BIGINT % {hashing.PRIME} AS x FROM sh)"
_MINIMA = ", ".join(f"min(({a} * x + {b}) % {hashing.PRIME})" for a, b in hashing.family(HASHES))
_SIG = f"sig AS (SELECT id, [{_MINIMA}] AS sig FROM x GROUP BY id)"


def _banded(r: int, b: int, name: str = "bands") -> str:
    cases = " UNION ALL ".join(
        f"SELECT id, {i} AS band, ('0x' || substr(md5(array_to_string(sig[{i * r + 1}:{(i + 1) * r}], ',')),"
        f" 1, 15))::BIGINT AS bucket FROM sig"
        for i in range(b)
    )
    return f"{name} AS ({cases})"


def _candidates(r: int, b: int, name: str, bands: str) -> str:
    return f"""{name} AS (
            SELECT e.id1, e.id2, len(list_filter(range(1, {r * b + 1}),
                   lambda i: u.sig[i] = v.sig[i])) / {r * b}::DOUBLE AS score
            FROM (SELECT DISTINCT a.id AS id1, z.id AS id2 FROM {bands} a JOIN {bands} z
                  ON a.band = z.band AND a.bucket = z.bucket AND a.id < z.id) e
            JOIN sig u ON u.id = e.id1 JOIN sig v ON v.id = e.id2)"""


_JACCARD = f"""n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
        o AS (SELECT a.id AS id1, b.id AS id2, count(*) AS common
              FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
        j AS (SELECT id1, id2, common / (u.n + v.n - common)::DOUBLE AS score
              FROM o JOIN n u ON u.id = id1 JOIN n v ON v.id = id2
              WHERE common / (u.n + v.n - common)::DOUBLE >= {T})"""
_ALL = f"WITH {_CLEAN}, {_shingled('c')}, {_X}, {_SIG}"
_DISTINCT = f"WITH {_TEXTS}, {_shingled('t')}, {_X}, {_SIG}"


def _quality(approx: str) -> str:
    return f"""(SELECT exact_pairs, approx_pairs, common_pairs,
               common_pairs::DOUBLE / nullif(exact_pairs, 0) AS recall,
               common_pairs::DOUBLE / nullif(approx_pairs, 0) AS "precision"
        FROM (SELECT coalesce(sum(CASE WHEN e THEN w END), 0)::BIGINT AS exact_pairs,
                     coalesce(sum(CASE WHEN a THEN w END), 0)::BIGINT AS approx_pairs,
                     coalesce(sum(CASE WHEN e AND a THEN w END), 0)::BIGINT AS common_pairs
              FROM (SELECT u.copies * v.copies AS w, p.e, p.a
                    FROM (SELECT coalesce(j.id1, l.id1) AS id1, coalesce(j.id2, l.id2) AS id2,
                                 j.id1 IS NOT NULL AS e, l.id1 IS NOT NULL AS a
                          FROM j FULL JOIN {approx} l ON j.id1 = l.id1 AND j.id2 = l.id2) p
                    JOIN t u ON u.id = p.id1 JOIN t v ON v.id = p.id2
                    UNION ALL
                    SELECT copies * (copies - 1) // 2, true, true FROM t
                    WHERE length(text) >= {K} AND copies > 1)))"""


ORACLE = {
    "shingles": f"WITH {_CLEAN}, {_shingled('c')} SELECT id, s AS shingle FROM sh",
    "shingle_hash": f"""
        WITH {_CLEAN}, {_shingled('c')}, {_X}
        SELECT id, count(x) AS n, min(x) AS least, max(x) AS most, sum(x)::BIGINT AS total
        FROM x GROUP BY id""",
    "minhash_sig": f"{_ALL} SELECT id, array_to_string(sig, ',') AS sig FROM sig",
    "lsh_bands": f"{_ALL}, {_banded(R, B)} SELECT id, band::BIGINT AS band, bucket FROM bands",
    "lsh_bucket_sizes": f"""
        {_ALL}, {_banded(R, B)}
        SELECT band::BIGINT AS band, bucket, count(*) AS n FROM bands GROUP BY 1, 2""",
    "text_copies": f"""
        WITH {_TEXTS}
        SELECT t.id AS id, c.id AS copy_id FROM t JOIN c ON t.text = c.text AND c.id > t.id""",
    "lsh_candidates": f"""
        {_DISTINCT}, {_banded(R, B)}, {_candidates(R, B, 'l', 'bands')}
        SELECT id1, id2, score FROM l""",
    "lsh_pairs": f"""
        {_DISTINCT}, {_banded(R, B)}, {_candidates(R, B, 'l', 'bands')}
        SELECT id1, id2, score FROM l WHERE score >= {T}""",
    "jaccard_pairs": f"WITH {_TEXTS}, {_shingled('t')}, {_JACCARD} SELECT id1, id2, score FROM j",
    "similar_documents": f"""
        WITH {_TEXTS}, {_shingled('t')}, {_JACCARD},
        m AS (SELECT c.id AS doc, t.id AS text_id FROM c JOIN t ON c.text = t.text),
        near AS (SELECT id1 AS a, id2 AS b FROM j UNION ALL SELECT id2, id1 FROM j UNION ALL SELECT id, id FROM t)
        SELECT q.doc AS id, p.doc AS partner FROM (SELECT DISTINCT doc_id FROM labels) l JOIN m q ON q.doc = l.doc_id
        JOIN near ON near.a = q.text_id JOIN m p ON p.text_id = near.b WHERE p.doc <> q.doc""",
    "pairs_intersect": f"""
        {_DISTINCT}, {_banded(R, B)}, {_candidates(R, B, 'l', 'bands')}, {_JACCARD}
        SELECT j.id1, j.id2 FROM j JOIN l ON j.id1 = l.id1 AND j.id2 = l.id2 WHERE l.score >= {T}""",
    "lsh_quality": f"""
        {_DISTINCT}, {_banded(R, B)}, {_candidates(R, B, 'l', 'bands')}, {_JACCARD},
        k AS (SELECT * FROM l WHERE score >= {T})
        SELECT * FROM {_quality('k')}""",
    "banding_sweep": f"""
        {_DISTINCT}, {_JACCARD},
        {', '.join(_banded(r, b, f'b{r}') + ', ' + _candidates(r, b, f'l{r}', f'b{r}') for r, b in SETTINGS)}
        {' UNION ALL '.join(f'SELECT {r}::BIGINT AS r, {b}::BIGINT AS b, * FROM ' + _quality(f'l{r}') for r, b in SETTINGS)}""",
}
