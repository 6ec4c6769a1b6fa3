from __future__ import annotations

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from millrace.operators import pruned_search, search, tfidf
from millrace.sources import pages, readers, sinks
from millrace.streaming import index_stream
from millrace.streaming.search_stream import answer_stream

HEADER = "title\thref\tcity\ttimestamp\tdescription\n"


def test_listings_keep_quotes_and_empty_fields(spark, tmp_path):
    path = tmp_path / "listings.tsv"
    path.write_text(HEADER + 'a "b\thttp://x\tRome\ttoday\t\n\t\t\t\t"only" text\n')
    rows = readers.read_listings(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [
        ('a "b', "http://x", "Rome", "today", ""), ("", "", "", "", '"only" text')]
    cleaned = sinks.clean_listings(readers.read_listings(spark, str(path)))
    assert cleaned.columns == ["title", "city", "description"]
    assert ("", "", "only text") in [tuple(r) for r in cleaned.collect()]


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('q"x', "tab\there", None), ("", "line\nbreak", "z")], "a string, b string, c string")
    sinks.write_tsv(df, str(tmp_path / "out"), ["c", "a", "b"])
    back = readers.read_tsv(spark, str(tmp_path / "out"), ["c", "a", "b"])
    assert sorted(tuple(r) for r in back.collect()) == [("", 'q"x', "tab here"), ("z", "", "line break")]


def test_field_by_position_and_several_files(spark, tmp_path):
    (tmp_path / "one").write_text('a\tb\tc "q\nd\te\n')
    assert [r.text for r in readers.read_field(spark, str(tmp_path / "one")).collect()] == ['c "q', None]
    for name in ("top", "regular"):
        (tmp_path / name).write_text(HEADER + f"{name}\th\tc\tt\td\nsame\th\tc\tt\td\n")
    both = readers.read_listings(spark, [str(tmp_path / "top"), str(tmp_path / "regular")])
    assert sorted(r.title for r in both.collect()) == ["regular", "same", "same", "top"]
    assert readers.union_all(both, both).count() == 8


def test_ratings_strip(spark, tmp_path):
    (tmp_path / "r").write_text(" ale \t 5\nbock\t3 \n")
    rows = [tuple(r) for r in readers.read_ratings(spark, str(tmp_path / "r")).collect()]
    assert rows == [("ale", 5), ("bock", 3)]


def test_prices_typed_and_inferred(spark, tmp_path):
    head = "Timestamp,Open,High,Low,Close,Volume_(BTC),Volume_(Currency),Weighted_Price\n"
    (tmp_path / "p.csv").write_text(head + "60,1.5,2,1,NaN,3,4,\n0,1,2,1,2,3,4,5\n")
    for infer in (False, True):
        rows = readers.read_prices(spark, str(tmp_path / "p.csv"), infer).orderBy("Timestamp").collect()
        assert rows[1].ts == dt.datetime(1970, 1, 1, 0, 1) and rows[1].Open == 1.5
        assert rows[1].Close is None and rows[1].Weighted_Price is None and rows[0].Close == 2.0


def test_lines_are_numbered_in_file_order_across_splits(spark, tmp_path):
    for name, start in (("a", 0), ("b", 1000)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(start, start + 1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        lines = spark.read.text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        numbered = readers.number_lines(lines, start=1).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.line for r in numbered) == list(range(1, 2001))
    assert all(r.value == f"line {r.line - 1}" for r in numbered)


def test_index_reloads_and_reads_as_text(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 3} tail{i}") for i in range(12)], "doc_id bigint, text string")
    built = tfidf.build_postings(docs, "doc_id", "text")
    sinks.write_index(built, str(tmp_path / "index"))
    loaded = sinks.load_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, built.collect()))
    nested = sinks.nested_postings(loaded, per_line=2).collect()
    assert sum(len(r.entries) for r in nested) == built.count()
    assert len([r for r in nested if r.term == "common"]) > 1
    sinks.write_readable_index(loaded, str(tmp_path / "text"))
    lines = [r.value.split("\t")[0] for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert set(lines) == {r.term for r in nested}


def test_readable_index_is_packed_text_shuffled_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 3} tail{i}") for i in range(12)], "doc_id bigint, text string")
    built = tfidf.build_postings(docs, "doc_id", "text")
    sinks.write_readable_index(built, str(tmp_path / "text"), per_line=2)
    files = sorted((tmp_path / "text").glob("part-*"))
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    lines = [line for f in files for line in gzip.decompress(f.read_bytes()).decode().splitlines()]
    terms = [line.split("\t")[0] for line in lines]
    assert terms == sorted(terms) and terms.count("common") > 1
    got = {(line.split("\t")[0], e["doc_id"], e["partial_score"]) for line in lines for e in json.loads(line.split("\t")[1])}
    assert got == {(r.term, r.doc_id, r.partial_score) for r in built.collect()}


def test_stored_result_is_built_once_per_parameters(spark, tmp_path):
    calls = []

    def build(n):
        def run():
            calls.append(n)
            return spark.range(n)
        return run

    for n, refresh in ((3, False), (3, False), (4, False), (3, True)):
        got = sinks.stored(spark, str(tmp_path), "ids", {"n": n}, build(n), refresh)
        assert got.count() == n
    assert calls == [3, 4, 3]


PAGE = """<html><body><div class="result topad"><ul><li class="item"><h3 class="title"> Top
 job</h3><a class="cta" href="/t">go</a><p class="description">d1</p><p class="locale">Rome</p>
 <p class="timestamp">now</p></li></ul></div>
 <div class="list"><div class="item"><h3 class="title">Job <b>two</b></h3><br><a class="cta big" href="/2">go</a>
 <p class="locale">Oslo</p></div></div></body></html>"""


def test_listings_of_a_page_and_their_regions(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "page_id bigint, html string")
    found = {r.href: r for r in pages.listings(df).collect()}
    assert set(found) == {"/t", "/2"}
    assert found["/2"].title == "Job two" and found["/2"].city == "Oslo"
    assert found["/2"].description is None and found["/2"].region == "list"
    assert found["/t"].description == "d1" and found["/t"].timestamp == "now"
    top = PAGE.replace("<ul>", "").replace("</ul>", "")
    df = spark.createDataFrame([(1, top)], "page_id bigint, html string")
    kept = pages.outside(pages.listings(df), "topad").collect()
    assert [r.href for r in kept] == ["/2"]


def test_stream_answers_equal_batch_and_come_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple"), (3, "pear")], "doc_id bigint, text string")
    weighted = tfidf.weights(tfidf.tokenised(docs, "doc_id", "text"))
    pruned_search.write_index(weighted, str(tmp_path / "index"), 4)
    index = pruned_search.load_index(spark, str(tmp_path / "index"), 4)
    arriving, answers = str(tmp_path / "arriving"), str(tmp_path / "answers")
    asked = [[(1, "apple"), (2, "pear red")], [(3, "green unknown")]]
    schema = "query_id bigint, text string"
    for queries in asked:
        spark.createDataFrame(queries, schema).write.mode("append").parquet(arriving)
        for _ in range(2):
            answer_stream(spark, arriving, schema, index, answers, str(tmp_path / "progress"), k=2)
    got = spark.read.parquet(answers).drop("batch")
    batch = search.search(tfidf.postings(weighted), spark.createDataFrame(sum(asked, []), schema), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_index_after_loads_equals_index_of_the_whole(spark, tmp_path):
    schema = "doc_id bigint, text string"
    loads = [[(1, "red apple red"), (2, "green apple")], [(3, "pear"), (4, None), (5, "")], [(6, "apple pear plum"), (7, "red plum")], []]
    arriving, store = str(tmp_path / "arriving"), str(tmp_path / "store")
    taken = []
    for load in loads:
        taken += load
        spark.createDataFrame(load, schema).write.mode("append").parquet(arriving)
        for _ in range(2):
            index_stream.grow(spark, arriving, schema, store)
        whole = tfidf.weights(tfidf.tokenised(spark.createDataFrame(taken, schema), "doc_id", "text"))
        grown = index_stream.grown_weights(spark, store)
        assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, whole.collect()))
