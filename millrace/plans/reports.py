"""Ratings, listings, hashes, pages, prefix rates, ledger and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.functions.text import escape_field
from millrace.operators import clustering, ledger, ordered, prefixes, ratings
from millrace.session import new_path, spread
from millrace.sources import pages as pg
from millrace.sources.readers import number_lines, read_field, read_prices, read_ratings, read_tsv, union_all
from millrace.sources.sinks import stored, write_tsv
from millrace.sources.tables import table

MIN_RATINGS = 30
SHARDS = 6
BUDGET = 100.0


def _ratings(spark, folder):
    lines = table(spark, folder, "lineitem", "l_partkey", "l_quantity")
    return lines.select(F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating"))


def top_items_by_count(spark, folder):
    return ratings.top_by_count(_ratings(spark, folder))


def top_items_by_mean(spark, folder):
    return ratings.top_by_mean(_ratings(spark, folder), min_count=MIN_RATINGS)


def union_listings(spark, folder):
    documents = table(spark, folder, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    passages = table(spark, folder, "benchmark").select(
        F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text"
    )
    return union_all(documents, passages)


def shard_assign(spark, folder):
    documents = table(spark, folder, "documents", "doc_id")
    sharded = ordered.shards(documents, "doc_id", None, SHARDS)
    return sharded.select("doc_id", "shard")


def escaped(spark, folder):
    documents = spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id")
    return documents.select("doc_id", escape_field(F.col("text")).alias("field"))


def hash_columns(spark, folder):
    documents = spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id")
    hashes = hashing.hash_columns(F.col("text"), seed=7)
    return documents.select("doc_id", *[c.alias(name) for name, c in hashes.items()])


def _pages(spark, folder):
    return spread(table(spark, folder, "pages", "page_id", "html"), "page_id")


def page_fields(spark, folder):
    return pg.page_fields(_pages(spark, folder))


def page_nodes(spark, folder):
    return pg.extracted(_pages(spark, folder), pg.linked_texts, "href string, label string").select("page_id", "href", "label")


def tsv_round_trip(spark, folder):
    """Documents as a TSV file with a header, written to the shared folder and read back."""
    path, columns = new_path(spark, "tsv"), ["doc_id", "source", "text"]
    write_tsv(table(spark, folder, "documents"), path, columns)
    return read_tsv(spark, path, columns)


def page_links(spark, folder):
    return pg.page_links(_pages(spark, folder)).withColumn("pos", F.col("pos").cast("bigint"))


def page_blocks(spark, folder):
    return pg.page_blocks(_pages(spark, folder)).withColumn("pos", F.col("pos").cast("bigint"))


def prefix_rates(spark, folder):
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    return prefixes.prefix_rates(events, "user_id", ["ts", "event_id"], "event_type", "purchase", "click")


def ledger_replay(spark, folder):
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    action = F.when(F.col("event_type") == "purchase", ledger.BUY).when(
        F.col("event_type") == "click", ledger.SELL
    ).otherwise(2)
    orders = events.withColumn("action", action)
    replayed = ledger.replay(orders, "user_id", ["ts", "event_id"], "value", "action", None, BUDGET)
    return replayed.select(
        "user_id", "event_id", F.col("action").cast("bigint").alias("action"),
        F.col("refused").cast("bigint").alias("refused"), "cash", "position", "reward",
    )


def kmeans1d(spark, folder):
    parts = table(spark, folder, "part", "p_brand", "p_size")
    found = clustering.kmeans_1d(parts, "p_brand", "p_size", 3)
    return found.select(
        "p_brand", F.col("cluster").cast("bigint").alias("cluster"), "low", "high", "n",
        F.round("cost", 6).alias("cost"),
    )


def cluster_sse(spark, folder):
    vectors = table(spark, folder, "embeddings", "label", "embedding")
    costs = clustering.cluster_cost(vectors, "label", "embedding")
    return costs.select(F.col("label").cast("bigint").alias("label"), "n", F.round("sse", 6).alias("sse"))


def taken_orders(spark, folder):
    """The steps of the ledger that asked to buy."""
    return ledger.taken(ledger_replay(spark, folder), ledger.BUY)


def field_round_trip(spark, folder):
    """Documents as a TSV file without header, of which one field is read by its position."""
    path = new_path(spark, "headerless")
    write_tsv(table(spark, folder, "documents"), path, ["doc_id", "source", "text"], header=False)
    return read_field(spark, path, 2)


def ratings_round_trip(spark, folder):
    """Ratings as a two-column TSV file, read back and counted."""
    path = new_path(spark, "ratings")
    rows = _ratings(spark, folder).select("item", F.col("rating").cast("int").alias("rating"))
    write_tsv(rows, path, ["item", "rating"], header=False)
    return read_ratings(spark, path).groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"), F.max("rating").alias("most")
    )


def prices_round_trip(spark, folder):
    """A day's prices of orders as a CSV file with header, missing ones NaN; read with its types."""
    path = new_path(spark, "prices")
    orders = table(spark, folder, "orders", "o_orderdate", "o_orderstatus", "o_totalprice")
    price = F.col("o_totalprice").cast("double")
    open_ = F.max(F.when(F.col("o_orderstatus") == "O", price))
    missing = lambda c: F.coalesce(c, F.lit(float("nan")))
    days = orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        missing(open_).alias("Open"), F.max(price).alias("High"), F.min(price).alias("Low"), missing(open_).alias("Close"),
        F.count(F.lit(1)).cast("double").alias("Volume_(BTC)"),
    )
    stamp = F.unix_timestamp(F.col("day").cast("timestamp")).alias("Timestamp")
    days.select(stamp, "Open", "High", "Low", "Close", "`Volume_(BTC)`", F.lit(0.0).alias("Volume_(Currency)"), F.lit(float("nan")).alias("Weighted_Price")).write.csv(
        path, header=True
    )
    read = read_prices(spark, path)
    return read.select(
        F.to_date("ts").alias("day"), F.col("Timestamp").alias("stamp"), F.col("Open").alias("open_price"), F.col("High").alias("high"),
        F.col("Low").alias("low"), F.col("`Volume_(BTC)`").alias("volume"), F.col("Weighted_Price").alias("weighted"),
    )


def numbered_lines(spark, folder):
    """Documents written in order of id; their lines numbered in file order, from 1."""
    path = new_path(spark, "lines")
    documents = table(spark, folder, "documents", "doc_id").where(F.col("doc_id").isNotNull())
    documents.orderBy("doc_id").select(F.col("doc_id").cast("string").alias("value")).write.text(path)
    return number_lines(spark.read.text(path), start=1).select("line", F.col("value").cast("bigint").alias("doc_id"))


def stored_counts(spark, folder):
    """Documents per source and language, kept under their parameters and input; the second use reads the first one's files."""
    base, documents = new_path(spark, "stored"), table(spark, folder, "documents", "source", "lang", "n_chars")
    build = lambda: documents.where(F.col("n_chars") >= 100).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    stored(spark, base, "counts", {"least": 100}, build, source=documents)
    return stored(spark, base, "counts", {"least": 100}, lambda: build().limit(0), source=documents)


QUERIES = {
    "top_items_by_count": top_items_by_count,
    "top_items_by_mean": top_items_by_mean,
    "union_listings": union_listings,
    "shard_assign": shard_assign,
    "escape_field": escaped,
    "hash_columns": hash_columns,
    "page_fields": page_fields,
    "page_nodes": page_nodes,
    "tsv_round_trip": tsv_round_trip,
    "page_links": page_links,
    "page_blocks": page_blocks,
    "prefix_rates": prefix_rates,
    "ledger_replay": ledger_replay,
    "kmeans1d": kmeans1d,
    "cluster_sse": cluster_sse,
    "taken_orders": taken_orders,
    "field_round_trip": field_round_trip,
    "ratings_round_trip": ratings_round_trip,
    "prices_round_trip": prices_round_trip,
    "numbered_lines": numbered_lines,
    "stored_counts": stored_counts,
}

def _decoded(sql: str) -> str:
    for entity, sign in pg.ENTITIES.items():
        quoted = sign.replace("'", "''")
        sql = f"replace({sql}, '{entity}', '{quoted}')"
    return sql


ORACLE = {
    "top_items_by_count": """
        SELECT l_partkey AS item, count(*) AS n FROM lineitem
        GROUP BY l_partkey ORDER BY n DESC, item DESC LIMIT 10""",
    "top_items_by_mean": f"""
        SELECT l_partkey AS item, avg(l_quantity) AS mean_rating, count(*) AS n FROM lineitem
        GROUP BY l_partkey HAVING count(*) >= {MIN_RATINGS}
        ORDER BY mean_rating DESC, item DESC LIMIT 10""",
    "union_listings": """
        SELECT 'documents' AS origin, doc_id AS id, text FROM documents
        UNION ALL SELECT 'benchmark' AS origin, item_id AS id, text FROM benchmark""",
    "shard_assign": f"""
        WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos,
                          count(*) OVER () AS total FROM documents)
        SELECT doc_id, CAST(floor(pos / ceil(total / {SHARDS}.0)) AS BIGINT) AS shard FROM n""",
    "escape_field": r"""
        SELECT doc_id, replace(replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
                       chr(10), ' '), chr(9), ' '), chr(13), '') AS field FROM documents""",
    "hash_columns": """
        SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::BIGINT AS h32,
               ('0x' || substr(md5(text), 1, 15))::BIGINT AS h60,
               (('0x' || substr(md5(text), 1, 8))::BIGINT
                - CASE WHEN substr(md5(text), 1, 1) >= '8' THEN 4294967296 ELSE 0 END) * 4294967296
               + ('0x' || substr(md5(text), 9, 8))::BIGINT AS h64, md5(text) AS h128,
               md5('7:' || text) AS seeded_h128 FROM documents""",
    "page_fields": f"""
        SELECT page_id, {_decoded(f"regexp_extract(html, '{pg.TITLE}', 1)")} AS title,
               {_decoded(f"regexp_extract(html, '{pg.HEADING}', 1)")} AS heading FROM pages""",
    "page_nodes": f"""
        WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s){pg.HREF}[^>]*>(.*?)</a>', 1) AS h,
                          regexp_extract_all(html, '(?s){pg.HREF}[^>]*>(.*?)</a>', 2) AS t FROM pages),
        r AS (SELECT page_id, unnest(h) AS h, unnest(t) AS t FROM l)
        SELECT page_id, {_decoded("h")} AS href, {_decoded(f"regexp_replace(t, '{pg.TAG}', '', 'g')")} AS label FROM r""",
    "tsv_round_trip": r"""
        SELECT doc_id::VARCHAR AS doc_id, coalesce(source, '') AS source,
               replace(replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
                       chr(10), ' '), chr(9), ' '), chr(13), '') AS text FROM documents""",
    "page_links": f"""
        WITH l AS (SELECT page_id, regexp_extract_all(html, '{pg.HREF}', 1) AS links FROM pages)
        SELECT page_id, unnest(range(len(links))) AS pos, unnest(links) AS href FROM l""",
    "page_blocks": f"""
        WITH b AS (SELECT page_id, regexp_extract_all(html, '{pg.BLOCK}', 1) AS regions,
                          regexp_extract_all(html, '{pg.BLOCK}', 2) AS texts FROM pages),
        r AS (SELECT page_id, unnest(range(len(regions))) AS pos, unnest(regions) AS region,
                     unnest(texts) AS text FROM b)
        SELECT page_id, pos, region, regexp_replace(text, '{pg.TAG}', ' ', 'g') AS text
        FROM r WHERE region <> 'div class="ad"'""",
    "prefix_rates": """
        WITH f AS (SELECT user_id, event_type AS k,
                          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        five AS (SELECT * FROM f WHERE rn <= 5),
        c AS (SELECT user_id, k, count(*) AS c FROM five GROUP BY user_id, k),
        shape AS (SELECT user_id, max(CASE WHEN c = 3 THEN 1 ELSE 0 END) AS three,
                         max(CASE WHEN c = 2 THEN 1 ELSE 0 END) AS two FROM c GROUP BY user_id),
        s AS (SELECT user_id,
                     max(CASE WHEN rn <= 2 AND k = 'purchase' THEN 1.0 ELSE 0.0 END) AS a,
                     max(CASE WHEN k = 'purchase' THEN 1.0 ELSE 0.0 END) AS b,
                     CASE WHEN max(CASE WHEN rn = 1 THEN k END) = max(CASE WHEN rn = 2 THEN k END)
                          THEN 1.0 ELSE 0.0 END AS c,
                     CASE WHEN sum(CASE WHEN k = 'click' THEN 1 ELSE 0 END) = 5 THEN 1.0 ELSE 0.0 END AS d
              FROM five GROUP BY user_id)
        SELECT count(*) AS samples, avg(a::DOUBLE) AS wanted_in_two, avg(b::DOUBLE) AS wanted_in_five,
               avg(c::DOUBLE) AS first_two_alike, avg(d::DOUBLE) AS five_uniform,
               avg(CASE WHEN three = 1 AND two = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS three_and_two
        FROM s JOIN shape USING (user_id)""",
    "ledger_replay": f"""
        WITH RECURSIVE o AS (
          SELECT user_id, event_id, value AS price,
                 CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS action,
                 row_number() OVER w AS rn, lead(value) OVER w AS after,
                 count(*) OVER (PARTITION BY user_id) AS n
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (
          SELECT user_id, 0::BIGINT AS rn, {BUDGET}::DOUBLE AS cash, 0.0::DOUBLE AS position,
                 NULL::BIGINT AS event_id, NULL::INTEGER AS action, NULL::BOOLEAN AS refused,
                 NULL::DOUBLE AS reward
          FROM (SELECT DISTINCT user_id FROM o)
          UNION ALL
          SELECT t.user_id, t.rn,
                 t.cash1, t.position1, t.event_id, t.action, t.refused,
                 (t.cash1 + t.position1 * t.after)
                   / nullif(CASE WHEN t.rn = t.n - 1 THEN {BUDGET}::DOUBLE
                                 ELSE t.cash0 + t.position0 * t.price END, 0) AS reward
          FROM (
            SELECT o.*, r.cash AS cash0, r.position AS position0,
                   (o.action = 0 AND r.cash < 0.5::DOUBLE * o.price)
                     OR (o.action = 1 AND r.position < 0.5::DOUBLE) AS refused,
                   CASE WHEN o.action = 0 AND r.cash >= 0.5::DOUBLE * o.price
                          THEN r.cash - 0.5::DOUBLE * o.price
                        WHEN o.action = 1 AND r.position >= 0.5::DOUBLE
                          THEN r.cash + 0.5::DOUBLE * o.price
                        ELSE r.cash END AS cash1,
                   CASE WHEN o.action = 0 AND r.cash >= 0.5::DOUBLE * o.price
                          THEN r.position + 0.5::DOUBLE
                        WHEN o.action = 1 AND r.position >= 0.5::DOUBLE
                          THEN r.position - 0.5::DOUBLE
                        ELSE r.position END AS position1
            FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1 AND o.rn < o.n) t)
        SELECT user_id, event_id, action::BIGINT AS action, refused::BIGINT AS refused,
               cash, position, reward
        FROM r WHERE rn > 0""",
    "kmeans1d": """
        WITH v AS (SELECT p_brand, p_size::DOUBLE AS x, count(*)::DOUBLE AS w FROM part GROUP BY 1, 2),
        y AS (SELECT *, x - min(x) OVER (PARTITION BY p_brand) AS y FROM v),
        p AS (SELECT p_brand, x, row_number() OVER o AS m, sum(w) OVER o AS sw,
                     sum(w * y) OVER o AS swx, sum(w * y * y) OVER o AS swxx
              FROM y WINDOW o AS (PARTITION BY p_brand ORDER BY x ROWS UNBOUNDED PRECEDING)),
        one AS (SELECT *, swxx - swx * swx / sw AS cost FROM p),
        t2 AS (SELECT b.p_brand, b.m, a.m AS l, a.cost + ((b.swxx - a.swxx)
                      - (b.swx - a.swx) * (b.swx - a.swx) / (b.sw - a.sw)) AS cost
               FROM one a JOIN p b ON a.p_brand = b.p_brand AND a.m < b.m),
        two AS (SELECT * FROM t2 QUALIFY row_number() OVER (PARTITION BY p_brand, m ORDER BY cost, l) = 1),
        d AS (SELECT p_brand, max(m) AS d FROM p GROUP BY 1),
        t3 AS (SELECT b.p_brand, b.m, a.m AS l2, a.l AS l1, a.cost + ((b.swxx - q.swxx)
                      - (b.swx - q.swx) * (b.swx - q.swx) / (b.sw - q.sw)) AS cost
               FROM two a JOIN p q ON a.p_brand = q.p_brand AND a.m = q.m
               JOIN d ON d.p_brand = a.p_brand JOIN p b ON b.p_brand = a.p_brand AND b.m = d.d AND a.m < b.m),
        best AS (SELECT * FROM t3 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY cost, l2) = 1),
        c AS (SELECT p_brand, 0 AS cluster, 0 AS a, l1 AS z, cost FROM best
              UNION ALL SELECT p_brand, 1, l1, l2, cost FROM best
              UNION ALL SELECT p_brand, 2, l2, m, cost FROM best)
        SELECT c.p_brand, c.cluster::BIGINT AS cluster, f.x AS low, t.x AS high,
               (t.sw - coalesce(e.sw, 0))::BIGINT AS n, round(c.cost, 6) AS cost
        FROM c JOIN p f ON f.p_brand = c.p_brand AND f.m = c.a + 1
        JOIN p t ON t.p_brand = c.p_brand AND t.m = c.z
        LEFT JOIN p e ON e.p_brand = c.p_brand AND e.m = c.a""",
    "cluster_sse": """
        WITH l AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x
                   FROM embeddings),
        d AS (SELECT label, dim, count(*) AS n, var_pop(x) AS v FROM l GROUP BY 1, 2)
        SELECT label::BIGINT AS label, max(n) AS n, round(sum(v * n), 6) AS sse FROM d GROUP BY 1""",
    "field_round_trip": r"""
        SELECT replace(replace(replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'),
                       chr(10), ' '), chr(9), ' '), chr(13), '') AS text FROM documents""",
    "ratings_round_trip": """
        SELECT l_partkey::VARCHAR AS item, count(*) AS n, sum(l_quantity::INTEGER)::BIGINT AS total,
               max(l_quantity::INTEGER) AS most FROM lineitem GROUP BY 1""",
    "prices_round_trip": """
        SELECT o_orderdate::DATE AS day, epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT AS stamp,
               max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END)::DOUBLE AS open_price,
               max(o_totalprice)::DOUBLE AS high, min(o_totalprice)::DOUBLE AS low, count(*)::DOUBLE AS volume,
               NULL::DOUBLE AS weighted
        FROM orders GROUP BY 1, 2""",
    "numbered_lines": """
        SELECT row_number() OVER (ORDER BY doc_id) AS line, doc_id FROM documents WHERE doc_id IS NOT NULL""",
    "stored_counts": """
        SELECT source, lang, count(*) AS n FROM documents WHERE n_chars >= 100 GROUP BY 1, 2""",
}
ORACLE["taken_orders"] = f"SELECT * FROM ({ORACLE['ledger_replay']}) WHERE action = 0"
