from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import pruned_search, ratings, search, tfidf

TEXTS = [
    (1, "The quick brown fox, the LAZY dog"),
    (2, "a an of 12 x9 été naïve foo_bar zz"),
    (3, ""),
    (4, None),
    (5, "to be or not"),
    (6, 'quick "quick" Quick fox\tand\nfox'),
]


def python_tokens(text):
    words = re.split(r"\W+", text or "")
    return [w.lower() for w in words if w and not re.fullmatch(r"[A-Za-z]{1,2}", w)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string")


def test_tokens_keep_digits_accents_and_long_words(spark, corpus):
    got = {r.doc_id: r.terms for r in tfidf.tokenised(corpus, "doc_id", "text").collect()}
    assert got == {i: python_tokens(t) for i, t in TEXTS}
    assert "12" in got[2] and "été" in got[2] and "zz" not in got[2]


def test_term_counts_in_row(spark, corpus):
    tokens = tfidf.tokenised(corpus, "doc_id", "text")
    got = {(r.doc_id, r.term): r.tf for r in tfidf.term_freq(tokens).collect()}
    expected = {(i, w): n for i, t in TEXTS for w, n in Counter(python_tokens(t)).items()}
    assert got == expected


def test_several_text_columns_are_one_bag(spark):
    df = spark.createDataFrame([(1, "red car", None, "red")], "id int, title string, city string, body string")
    rows = tfidf.term_freq(tfidf.tokenised(df, "id", "title", "city", "body")).collect()
    assert {r.term: r.tf for r in rows} == {"red": 2, "car": 1}


def test_escape_field(spark):
    df = spark.createDataFrame([(" \n a\tb\nc\rd \t",)], "t string")
    assert df.select(tx.escape_field(F.col("t"))).first()[0] == "a b cd"


def test_term_in_every_document_and_norm_zero(spark):
    df = spark.createDataFrame([(1, "all"), (2, "all other")], "doc_id bigint, text string")
    built = {(r.term, r.doc_id): r.partial_score for r in tfidf.build_postings(df, "doc_id", "text").collect()}
    assert set(built) == {("all", 2), ("other", 2)}
    assert built[("all", 2)] == 0.0
    assert built[("other", 2)] == pytest.approx(math.log10(2))


def brute_force(docs, queries, k):
    n = len(docs)
    tf = {i: Counter(python_tokens(t)) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    result = {}
    for q, text in queries:
        asked = Counter(python_tokens(text))
        scored = defaultdict(float)
        for i, counts in tf.items():
            idf = {w: math.log10(n / df[w]) for w in counts}
            norm = math.sqrt(sum((counts[w] * idf[w]) ** 2 for w in counts))
            shared = set(counts) & set(asked)
            if norm and shared:
                scored[i] = sum(counts[w] * idf[w] ** 2 / norm * asked[w] for w in shared)
        best = sorted(((round(s, 9), i) for i, s in scored.items()), reverse=True)[:k]
        result[q] = [i for _, i in best]
    return result


@pytest.mark.parametrize("rows_per_part", [1, 2, 1_000_000])
def test_search_equals_brute_force_however_terms_are_cut(spark, corpus, rows_per_part):
    queries = [(1, "quick quick fox unknown"), (2, "été 12"), (3, "zz"), (4, "the dog or not")]
    asked = spark.createDataFrame(queries, "query_id int, text string")
    index = tfidf.build_postings(corpus, "doc_id", "text")
    found = search.top_k(search.scores(index, asked, rows_per_part=rows_per_part), 2)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    assert got == {q: ids for q, ids in brute_force(TEXTS, queries, 2).items() if ids}


def test_equal_documents_rank_by_larger_id(spark):
    df = spark.createDataFrame([(i, "apple") for i in (1, 2, 3)] + [(4, "pear")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "apple")], "query_id int, text string")
    tokens = tfidf.tokenised(df, "doc_id", "text")
    rows = search.search_corpus(tokens, asked, 2).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [3, 2]
    full = search.hydrate(search.search_corpus(tokens, asked, 2), df, "doc_id", ["text"])
    assert {(r.doc_id, r.text, r.line) for r in full.collect()} == {(3, "apple", 4), (2, "apple", 3)}


def test_top_items(spark):
    rows = [("a", 5)] * 3 + [("b", 4)] * 3 + [("c", 5)] * 2 + [("d", 1)]
    df = spark.createDataFrame(rows, "item string, rating int")
    assert [r.item for r in ratings.top_by_count(df, k=3).collect()] == ["b", "a", "c"]
    assert [r.item for r in ratings.top_by_mean(df, min_count=2).collect()] == ["c", "a", "b"]
    assert [r.item for r in ratings.top_by_mean(df, min_count=3).collect()] == ["a", "b"]


def _zipf_corpus(seed, documents, words):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % words:04d}x"
    return [(i, " ".join(word() for _ in range(rng.choice([3, 10, 60, 200])))) for i in range(documents)], word, rng


@pytest.mark.parametrize("first_rows", [1, 40, 10**9])
def test_pruned_search_loses_nothing(spark, first_rows, tmp_path):
    docs, word, rng = _zipf_corpus(1, 500, 900)
    docs += [(None, docs[3][1]), (1000, docs[3][1]), (1001, None), (1002, "")]
    asked = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 12])))) for i in range(50)]
    asked += [(50, docs[3][1]), (51, "nowhere"), (52, None), (None, docs[5][1]), (53, "w0001x " * 3)]
    schema = "doc_id bigint, text string"
    weighted = tfidf.weights(tfidf.tokenised(spark.createDataFrame(docs, schema), "doc_id", "text"))
    queries = spark.createDataFrame(asked, "query_id bigint, text string")
    pruned_search.write_index(weighted, str(tmp_path / "i"), 8)
    index = pruned_search.load_index(spark, str(tmp_path / "i"), 8)
    key = lambda r: tuple(r)
    exhaustive = sorted(map(key, search.search(tfidf.postings(weighted), queries, 5).collect()), key=repr)
    assert sorted(map(key, pruned_search.search_index(index, queries, 5, first_rows=first_rows).collect()), key=repr) == exhaustive


def test_frequent_terms_are_read_for_few_documents(spark, tmp_path):
    """A term of every other document is looked up only where it can change the result; its bucket alone is read."""
    docs = [(i, f"rare{i % 50} {'common' if i % 2 else 'other'} " + "filler " * (i % 7)) for i in range(2000)]
    weighted = tfidf.weights(tfidf.tokenised(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text"))
    path = str(tmp_path / "i")
    pruned_search.write_index(weighted, path, 16)
    index = pruned_search.load_index(spark, path, 16)
    queries = spark.createDataFrame([(1, "rare7 common"), (2, "rare8 common")], "query_id bigint, text string")
    asked, buckets = pruned_search._asked(index, queries, "query_id", "text", 100)
    rare = index.within(index.postings, buckets).join(asked.where("rare"), ["bucket", "term"])
    found = rare.select("query_id", "doc_id", "block", (F.col("partial_score") * F.col("query_tf")).alias("score"))
    terms = pruned_search.optional_terms(index, asked, found, 5, buckets)
    assert index.postings.where("term = 'common'").count() == 1000
    assert terms.where("optional").count() > 0 and terms.where("not optional").count() == 0
    looked_up = pruned_search.looked_up(index.within(index.postings, buckets), found, terms, 5)
    assert 0 < looked_up.count() <= 40
    assert 0 < len(buckets) <= 3
    read = index.within(index.postings, buckets).select(F.input_file_name().alias("f")).distinct().collect()
    stored = index.postings.select(F.input_file_name().alias("f")).distinct().count()
    assert {int(r.f.split("bucket=")[1].split("/")[0]) for r in read} <= set(buckets) and len(read) < stored
    one = spark.createDataFrame([(1, "rare7")], "query_id bigint, text string")
    assert len(pruned_search._asked(index, one, "query_id", "text", 100)[1]) == 1


def test_an_index_for_one_search_keeps_documents_whole(spark, tmp_path):
    """A document's postings lie in one file, so that its score is summed there; bounds and dictionary are no single task's work."""
    docs, word, rng = _zipf_corpus(3, 400, 500)
    weighted = tfidf.weights(tfidf.tokenised(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), "doc_id", "text"))
    partitions = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pruned_search.write_index(weighted, str(tmp_path / "i"), 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions)
    index = pruned_search.load_index(spark, str(tmp_path / "i"), 1)
    files = index.postings.select("doc_id", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("doc_id").count().where("count > 1").count() == 0
    for stored in (index.postings, index.blocks, index.terms):
        assert stored.select(F.input_file_name()).distinct().count() > 1
    queries = spark.createDataFrame([(i, " ".join(word() for _ in range(6))) for i in range(20)], "query_id bigint, text string")
    exhaustive = sorted(map(tuple, search.search(tfidf.postings(weighted), queries, 5).collect()))
    assert sorted(map(tuple, pruned_search.search_index(index, queries, 5, first_rows=30).collect())) == exhaustive


def test_a_search_deletes_what_it_has_read(spark):
    """of a search's stored tables only those that its result reads are left."""
    rows = [(i, f"word{i % 7} other{i % 3} alpha beta{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    queries = spark.createDataFrame([(1, "alpha word3 beta5"), (2, "other1 beta7 alpha")], "query_id bigint, text string")
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "millrace"
    before = set(folder.iterdir()) if folder.exists() else set()
    found = pruned_search.search_corpus(tfidf.weights(tfidf.tokenised(df, "id", "text")), queries, 5)
    assert not [p.name for p in set(folder.iterdir()) - before if p.name.startswith(("query-terms", "known-terms", "rare-scores"))]
    assert found.count() == 10
