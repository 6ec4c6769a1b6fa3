from __future__ import annotations

import random
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.operators import jaccard, minhash, quality, shingles, skew

K = 4


def sets_of(docs, k=K):
    return {i: {t[j : j + k] for j in range(len(t) - k + 1)} for i, t in docs if t and len(t) >= k}


def exact_pairs(docs, t):
    sets = sets_of(docs)
    found = {}
    for i, j in combinations(sorted(sets), 2):
        score = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        if score >= t:
            found[(i, j)] = score
    return found


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(5)
    texts = []
    for _ in range(8):
        base = "".join(draw.choice("abcd é") for _ in range(draw.randrange(10, 60)))
        for _ in range(6):
            chars = list(base)
            for _ in range(draw.randrange(4)):
                chars[draw.randrange(len(chars))] = draw.choice("abcdxyz")
            texts.append("".join(chars))
    texts += ["abc", "", None, "aaaaaaaaaa", "aaaaaa", "aaaa"]
    return list(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame(docs, "id bigint, text string")


def test_shingles_of_any_script_and_length(spark):
    docs = [(1, "abcdé"), (2, "abc"), (3, None), (4, "😀bcd"), (5, "aaaaaa")]
    got = {(r.id, r.shingle) for r in shingles.shingle_sets(frame(spark, docs), K).collect()}
    assert got == {(i, s) for i, one in sets_of(docs).items() for s in one}
    sizes = frame(spark, docs).select("id", F.size(shingles.shingle_hashes(F.col("text"), K)).alias("n"))
    assert {r.id: r.n for r in sizes.collect() if r.n > 0} == {i: len(s) for i, s in sets_of(docs).items()}


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_jaccard_equals_all_pairs(spark, docs, t):
    texts = shingles.distinct_texts(frame(spark, docs))
    kept = {r.id for r in texts.collect()}
    got = {(r.id1, r.id2): r.score for r in jaccard.jaccard_pairs(texts, t, K).collect()}
    assert got == exact_pairs([d for d in docs if d[0] in kept], t)


def test_threshold_must_be_positive(spark, docs):
    with pytest.raises(ValueError):
        jaccard.jaccard_pairs(frame(spark, docs), 0.0, K)


def test_copies_collapse_to_a_star(spark):
    df = frame(spark, [(3, "same text"), (1, "same text"), (2, "other"), (7, "same text")])
    texts = {(r.id, r.text, r.copies) for r in shingles.distinct_texts(df).collect()}
    assert texts == {(1, "same text", 3), (2, "other", 1)}
    assert {(r.id, r.copy_id) for r in shingles.copy_links(df).collect()} == {(1, 3), (1, 7)}


@pytest.mark.parametrize("rows_per_cell", [1, 2, 5, 100])
def test_pairs_within_meets_each_pair_once_however_groups_are_cut(spark, rows_per_cell):
    rows = [("hot", i, i % 3, 20) for i in range(20)] + [("cold", i, 0, 2) for i in (50, 51)]
    df = spark.createDataFrame(rows, "key string, id bigint, v int, n bigint")
    met = skew.pairs_within(df, ["key"], "id", "n", ["v"], lambda a, b: a["v"] == b["v"], rows_per_cell)
    got = sorted((r.key, r.a.id, r.b.id) for r in met.collect())
    expected = sorted(
        (k, i, j) for k, i, v, _ in rows for l, j, w, _ in rows if k == l and i < j and v == w
    )
    assert got == expected


@pytest.mark.parametrize("rows_per_part, hot_share", [(1, 0.0), (3, 0.1), (1_000_000, 1e-4)])
def test_attach_loses_nothing_of_hot_keys(spark, rows_per_part, hot_share):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "id bigint, key string")
    freq = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = skew.attach(rows, freq, ["key"], "id", "n", rows_per_part, hot_share)
    got = sorted((r.id, r.key, r.n) for r in joined.collect())
    assert got == sorted((i, "hot" if i % 3 else f"k{i}", 40 if i % 3 else 1) for i in range(60))


def test_hashes_on_arrays_equal_their_columns(spark):
    """F4, F7, F8, F11, F16, F17: hashes are made for many texts at once, and no row per shingle."""
    rng = random.Random(10)
    rows = [(i, "".join(rng.choice("abc é語😀") for _ in range(n))) for i, n in enumerate((0, 3, 4, 5, 50, 700, 9))]
    rows += [(50, None), (4, "one id twice"), (None, "no id at all"), (None, "nor here")]
    df = frame(spark, rows)
    known = df.select("id", F.explode(shingles._in_row(F.col("text"), K, hashing.base_hash)).alias("x"))
    hashes = {(r.id, x) for r in shingles.hashed_shingles(df, K).collect() for x in r.hashes}
    assert hashes == set(map(tuple, known.collect()))
    minima = [F.min(hashing.seeded(F.col("x"), a, b)) for a, b in hashing.family(5)]
    expected = {tuple(r)[0]: list(r)[1:] for r in known.groupBy("id").agg(*minima).collect()}
    sigs = minhash.signatures(df, 5, K)
    assert {r.id: r.sig for r in sigs.collect()} == expected
    assert "Generate" not in sigs._jdf.queryExecution().optimizedPlan().toString()


def test_lsh_finds_equal_sets_and_scores_shared_hashes(spark, docs):
    sigs = minhash.signatures(shingles.distinct_texts(frame(spark, docs)), 12, K)
    known = {r.id: r.sig for r in sigs.collect()}
    got = {(r.id1, r.id2): r.score for r in minhash.lsh_pairs(sigs, 3, 4).collect()}
    expected = {}
    for i, j in combinations(sorted(known), 2):
        if any(known[i][s : s + 3] == known[j][s : s + 3] for s in range(0, 12, 3)):
            expected[(i, j)] = sum(u == v for u, v in zip(known[i], known[j])) / 12
    assert got == expected
    filtered = {(r.id1, r.id2) for r in minhash.lsh_pairs(sigs, 3, 4, 0.75).collect()}
    assert filtered == {p for p, s in expected.items() if s >= 0.75}
    # Different texts with one shingle set have one signature.
    same = {i for i, t in docs if t in ("aaaaaaaaaa", "aaaaaa", "aaaa")}
    assert {p for p in got if set(p) <= same} == set(combinations(sorted(same), 2))


def test_quality_counts_document_pairs(spark):
    pairs = "id1 bigint, id2 bigint"
    exact = spark.createDataFrame([(1, 2), (1, 3)], pairs)
    approx = spark.createDataFrame([(1, 2), (2, 3)], pairs)
    weights = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id bigint, copies bigint")
    row = quality.pair_quality(exact, approx, weights).first()
    # 1-2 stands for 6 pairs, 1-3 for 2, 2-3 for 3; copies among themselves for 1 + 3.
    assert (row.exact_pairs, row.approx_pairs, row.common_pairs) == (12, 13, 10)
    none = quality.pair_quality(exact.limit(0), approx.limit(0), weights.limit(0)).first()
    assert (none.exact_pairs, none.recall, none.precision) == (0, None, None)
    assert quality.common_pairs(exact, approx).collect() == [(1, 2)]


def test_recall_and_precision_on_documents(spark):
    from millrace.plans import neardup

    row = neardup.lsh_quality(spark, "/root/testdata/sf0.01").first()
    assert row.exact_pairs == 161 and row.recall >= 0.9 and row.precision >= 0.9


def test_partners_resolve_to_documents(spark):
    draw = random.Random(2)
    base = ["abcdefgh", "abcdefgi", "abcdefgh", "zzzzyyyy", "abcdefgh", "qrstuvwx", "qrstuvwx"]
    docs = list(enumerate(base))
    draw.shuffle(docs)
    df = frame(spark, docs)
    pairs = jaccard.jaccard_pairs(shingles.distinct_texts(df), 0.5, K)
    asked = df.where("id != 4").select("id")
    got = sorted(map(tuple, quality.partners(pairs, shingles.copy_links(df), asked).collect()))
    full = exact_pairs(docs, 0.5)
    expected = sorted((i, j) for p in full for i, j in (p, p[::-1]) if i != 4)
    assert got == expected


def test_equal_signatures_are_a_star(spark):
    """A large group of equal signatures takes part in pairs as one, and costs a row per member."""
    rows = [(i, [1, 2, 3, 4]) for i in range(5000)] + [(9000, [1, 2, 7, 8]), (9001, [5, 6, 7, 8]), (9002, [9, 9, 9, 9])]
    sigs = spark.createDataFrame(rows, "id bigint, sig array<int>").repartition(4)
    pairs, members = minhash.lsh_classes(sigs, 2, 2)
    assert sorted(map(tuple, pairs.collect())) == [(0, 9000, 0.5), (9000, 9001, 0.5)]
    assert members.count() == len(rows) and members.where("first = 0").count() == 5000
    few = spark.createDataFrame(rows[4997:], "id bigint, sig array<int>")
    got = sorted(map(tuple, minhash.lsh_pairs(few, 2, 2).collect()))
    assert got == [(4997, 4998, 1.0), (4997, 4999, 1.0), (4997, 9000, 0.5), (4998, 4999, 1.0), (4998, 9000, 0.5), (4999, 9000, 0.5), (9000, 9001, 0.5)]


def test_signatures_do_not_travel_before_pairs(spark):
    sigs = spark.createDataFrame([(i, [i % 7, 2, 3, i % 5]) for i in range(50)], "id bigint, sig array<int>")
    pairs = minhash.candidate_pairs(minhash.bands(sigs, 2, 2))
    assert pairs.columns == ["id1", "id2"]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert all("sig" not in line for line in plan.splitlines() if "Join" in line or "Aggregate" in line)


@pytest.mark.parametrize("texts, slots", [(1, 4), (10, 64), (10_000, 1 << 16)])
def test_pairs_do_not_depend_on_the_token_order(spark, monkeypatch, texts, slots):
    monkeypatch.setattr(jaccard, "frequency_levels", lambda sets, real=jaccard.frequency_levels: real(sets, texts, slots))
    rng = random.Random(6)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(15, 80))) for _ in range(30)]
    rows = list(enumerate(dict.fromkeys(b[:k] + x + b[k:] for b in base for k, x in ((0, ""), (5, "z"), (len(b), "qq")))))
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("id", "text", "1 AS copies")
    sets = {i: {t[k : k + 4] for k in range(len(t) - 3)} for i, t in rows}
    expected = {(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and sets[a]}
    found = jaccard.jaccard_pairs(df, 0.8, 4).collect()
    assert {(r.id1, r.id2) for r in found} == expected and expected


def test_no_table_of_prefix_tokens_is_written(spark):
    """F1-F5: what pairs are found with is smaller than the texts; a row per prefix token was several times as large."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(2000)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t[:1000] + "#" + t[1000:]) for i, t in enumerate(texts[:20])]
    df = frame(spark, rows).selectExpr("id", "text", "1 AS copies").repartition(3)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    found = jaccard.jaccard_pairs(df, 0.8, 10)
    assert {(r.id1, r.id2) for r in found.collect()} == {(i, 1000 + i) for i in range(20)}
    assert size() - before < sum(len(t) for _, t in rows) / 4


def test_frequent_prefix_tokens_and_repeated_ids(spark):
    """A token of more texts than meet in its bucket's task, and ids that name two texts, lose no pair."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, base[: 3 * i] + "#" + base[3 * i :]) for i in range(90)]
    found = {(r.id1, r.id2) for r in jaccard.jaccard_pairs(frame(spark, rows), 0.8, K).collect()}
    assert found == set(exact_pairs(rows, 0.8)) and len(found) > 3000
    other = "".join(rng.choice("klmnop ") for _ in range(200))
    twice = [(1, base), (2, base + "x"), (1, other), (3, other + "y"), (None, base + "z")]
    assert {(r.id1, r.id2) for r in jaccard.jaccard_pairs(frame(spark, twice), 0.8, K).collect()} == {(1, 2), (1, 3)}


def test_pairs_of_few_common_tokens_are_not_written(spark, monkeypatch):
    """F1-F5: texts that share a phrase need more than that in common; each two of them were a row per bucket."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = []
    for _ in range(12):
        phrase = word(14)
        rows += [word(300) + phrase + word(300) for _ in range(40)]
    rows = list(enumerate(rows + [rows[0][:-30] + "#" + rows[0][-30:]]))
    written = {}

    def kept(df, label, real=jaccard.stage):
        staged = real(df, label)
        written[label] = staged.count()
        return staged

    monkeypatch.setattr(jaccard, "stage", kept)
    assert [(r.id1, r.id2) for r in jaccard.jaccard_pairs(frame(spark, rows), 0.8, K).collect()] == [(0, 480)]
    assert written["met-tokens"] < 50


@pytest.mark.parametrize("t", [0.3, 0.8])
def test_pairs_do_not_depend_on_buckets_and_cells(spark, monkeypatch, t):
    """Sets of unlike sizes, dealt to many buckets, counted a few pairs at a time, with tokens that meet in cells."""
    rng = random.Random(14)
    base = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (40, 130, 260, 500)]
    rows = [b[rng.randrange(len(b) // 4) : len(b) - rng.randrange(len(b) // 4)] for b in base for _ in range(25)]
    rows = list(enumerate(dict.fromkeys(r[:k] + "#" + r[k:] if i % 3 else r for i, r in enumerate(rows) for k in (len(r) // 2,))))
    for name, value in (("BUCKET_TOKENS", 300), ("MET_PAIRS", 50), ("GROUP", 12)):
        monkeypatch.setattr(jaccard, name, value)
    found = [(r.id1, r.id2) for r in jaccard.jaccard_pairs(frame(spark, rows), t, K).collect()]
    assert len(found) == len(set(found)) and set(found) == set(exact_pairs(rows, t)) and len(found) > 100
