"""Packing, mixing, token files, passages, vectors and the pipeline against brute force on small tables."""

from __future__ import annotations

import math
import pathlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing, packing, passages, plans, token_files, vector_graph
from millrace.llm.common import documents
from millrace.llm.tokens import encoder, tokenizer_path, wide

FOLDER = "/root/testdata/sf0.001"
PATH = tokenizer_path()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, line string"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "word", "en", "t"), (5, "a b", None, "a"),
    (None, "some words are here", "en", "a"), (None, None, None, None), (7, "long words " * 9_000, "en", "b"),
    (7, "long words " * 9_000, "en", "b"), (8, "é ü 漢字 \U0001f600 'S x's é\x1c ", "fr", "b"), (9, "<|endoftext|> it's", "en", "b"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y") for r in rows], SCHEMA)


def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# tokens

def test_encoder_equals_the_tokenizer():
    coder = encoder(PATH)
    texts = [t for _, t, *_ in ODD] + ["Straße. ÉTÉ, don't I'll\n\nx" * 3, "ΟΔΟΣ. ΟΔΟΣ", "a.b,c;d", "İstanbul ŉ ǆ", "Á. ét"]
    assert coder.by_piece
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(wide(coder.encode(t), coder.kind), dtype="<u4").tolist() == (_ids(t) if t else [])


# packing

def _check_packing(spark, rows, found):
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding <= 0.01 * sum(r["length"] for r in found)
    expected = {}
    for i, text, *_ in rows:
        ids = [*(_ids(text) if text else []), 1]
        expected.setdefault((i, len(ids)), []).append(ids)
    assert set(by_doc) == set(expected)
    for k, docs in expected.items():
        pieces = sorted(by_doc[k])
        assert len(pieces) % len(docs) == 0 or len(docs) > 1
        if len(docs) == 1:
            at = 0
            for start, length, crc in pieces:
                assert start == at and crc == _crc(docs[0][start : start + length])
                at += length
            assert at == k[1]
        else:
            assert sum(p[1] for p in pieces) == k[1] * len(docs)
            assert all(crc in {_crc(d[start : start + length]) for d in docs} for start, length, crc in pieces)


def test_packing_holds_every_id_once(spark, monkeypatch):
    rows = [*ODD, *[(100 + i, "some more words here " * (i % 40), "en", f"s{i % 5}") for i in range(200)]]
    _check_packing(spark, rows, packing.packed(table(spark, rows), PATH).collect())
    monkeypatch.setattr(packing, "PART_TOKENS", 3 * packing.WINDOW)
    _check_packing(spark, rows, packing.packed(table(spark, rows).repartition(5), PATH).collect())
    assert packing.packed(table(spark, rows).limit(0), PATH).collect() == []


def test_windows_keep_source_proportions(spark):
    rows = [(i, "words of a text " * (20 + i % 30), "en", "abb"[i % 3] if i % 7 else "c") for i in range(900)]
    found = packing.packed(table(spark, rows), PATH).join(table(spark, rows).select("doc_id", "source"), "doc_id").groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()
    total = sum(r["n"] for r in found)
    share = {s: sum(r["n"] for r in found if r["source"] == s) / total for s in "abc"}
    full = {}
    for r in found:
        full.setdefault(r["sequence_id"], {})[r["source"]] = r["n"]
    for counts in full.values():
        if sum(counts.values()) == packing.WINDOW:
            for s in "abc":
                assert abs(counts.get(s, 0) / packing.WINDOW - share[s]) <= 2 * packing.QUANTUM / packing.WINDOW


def test_partition_borders_agree():
    rng = random.Random(1)
    for _ in range(300):
        total, parts, line = rng.randrange(1, 10**6), rng.randrange(1, 400), f"s{rng.randrange(99)}"
        borders = [packing.border(p, line, total, parts) for p in range(parts + 1)]
        assert borders[0] == 0 and borders[-1] == total and borders == sorted(borders)
        for _ in range(20):
            at = rng.randrange(total)
            p = packing.part_of(at, line, total, parts)
            assert borders[p] <= at < borders[p + 1]


# mixing

def _targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def _check_mix(rows, found):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = _targets(sizes)
    key = lambda r: tuple((x is None, x) for x in r)
    expected = sorted(((i, size(t), sizes[s], round(targets[s], 6)) for i, t, _, s in rows), key=key)
    assert sorted(((r["id"], r["size"], r["source_size"], round(r["target"], 6)) for r in found), key=key) == expected
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    by = {}
    for r in found:
        by.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    for (_, target), taken in by.items():
        same = sum(1 for s in sizes if (sizes[s], round(targets[s], 6)) == (_, target))
        assert abs(sum(taken) - same * target) <= same * mixing.BLOCK


def test_mixing_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [*ODD, *[(100 + i, "a word " * rng.randrange(300), "en", rng.choice([None, "s1", "s2", "s3", "é", "Z"])) for i in range(400)]]
    rows += rows[50:60]
    docs = table(spark, rows)
    first = mixing.taken(docs).collect()
    _check_mix(rows, first)
    again = mixing.taken(docs.repartition(7)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, first), key=key) == sorted(map(tuple, again), key=key)
    assert mixing.taken(docs.limit(0)).collect() == []


def test_mixed_documents_hold_what_is_taken(spark):
    rng = random.Random(9)
    rows = [*ODD[:7], *[(100 + i, " ".join(f"w{i}-{k}" for k in range(rng.randrange(200))) + "\n", "en", f"s{i % 4}") for i in range(60)]]
    rows += rows[20:22]
    docs = table(spark, rows)
    count = {}
    for r in mixing.mixed_documents(docs).collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + len((r["text"] or "").split())
        assert r["text"] and set(r["text"].split()) <= {w for i, t, *_ in rows if i == r["doc_id"] for w in (t or "").split()}
    expected = {}
    for r in mixing.taken(docs).collect():
        expected[r["id"]] = expected.get(r["id"], 0) + r["taken"]
    assert count == {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 17, 64, 1000, 4097])
def test_permutations_are_bijections(spark, n):
    frame = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit("key")).alias("y"))
    got = [r["y"] for r in frame.collect()]
    assert sorted(got) == list(range(n))
    if n > 60:
        assert sum(a == i for i, a in enumerate(got)) < n / 4


def test_shard_counts_spread_like_a_draw(spark):
    plan = spark.createDataFrame([("a", 3000, 3000, 0, 4000), ("b", 1000, 1000, 3000, 4000)], "line string, blocks long, slots long, first_slot long, all_slots long")
    counts = [r["count"] for r in mixing.slots(plan, shard=100).where("line = 'a'").groupBy("shard").count().collect()]
    assert len(counts) == 40 and sum(counts) == 3000
    deviation = math.sqrt(sum((c - 75) ** 2 for c in counts) / 40)
    assert 2 < deviation < 7  # 4.3 for a draw of 100


# token files

def test_token_files_round_trip(spark, tmp_path):
    rows = [*ODD, *[(100 + i, f"text number {i} " * (i % 9), "en", "s") for i in range(150)]]
    files = token_files.write_files(table(spark, rows), PATH, str(tmp_path / "files"), file_ids=500)
    assert files.count() > 3
    found = token_files.read_files(files).orderBy("start").collect()
    at = 0
    for r in found:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and r["ids_crc32"] == _crc(ids) and ids[-1] == 2
        at += len(ids)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    got = sorted(((r["doc_id"], np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in found), key=key)
    assert got == sorted(((i, [*(_ids(t) if t else []), 2]) for i, t, *_ in rows), key=key)
    names = [r["doc_id"] for r in found]
    assert names == sorted(names, key=lambda x: (x is not None, x or 0))
    some = token_files.read_files(files, wanted={120, 7}).collect()
    assert sorted(r["doc_id"] for r in some) == [7, 7, 120]
    assert token_files.read_files(token_files.write_files(table(spark, rows).limit(0), PATH)).collect() == []


def test_damaged_frames_are_noticed(tmp_path):
    path = str(tmp_path / "x.tokens.zst")
    writer = token_files.Writer(path)
    for i in range(5):
        writer.add(i, np.arange(i * 1000, i * 1000 + 300, dtype="<u4").tobytes())
    writer.close()
    reader = token_files.Reader(path)
    assert reader.names == list(range(5)) and np.frombuffer(reader.read(3), dtype="<u4")[0] == 3000
    data = bytearray(open(path, "rb").read())
    data[int(reader.starts[2]) + 30] ^= 255
    open(path, "wb").write(bytes(data))
    reader = token_files.Reader(path)
    reader.read(1)
    with pytest.raises(Exception):
        reader.read(2)
    (tmp_path / "y").write_bytes(b"not a token file at all")
    with pytest.raises(ValueError):
        token_files.Reader(str(tmp_path / "y"))


# passages

def _slow_windows(values, least):
    out = set()
    for c in range(len(values)):
        l, r = c, c
        while l and values[l - 1] > values[c]:
            l -= 1
        while r + 1 < len(values) and values[r + 1] >= values[c]:
            r += 1
        if r - l + 1 >= least:
            out.add((l, c, r))
    return out


def test_compact_windows_equal_a_scan():
    rng = np.random.default_rng(2)
    for n, least in [(3, 4), (4, 4), (50, 7), (300, 40), (301, 20)]:
        values = rng.integers(0, 2**64, (3, n), dtype=np.uint64)
        got = passages.compact_windows(values, least)
        for h in range(3):
            assert {x[1:] for x in got if x[0] == h} == _slow_windows(values[h].tolist(), least)
            assert len([x for x in got if x[0] == h]) <= 4 * n / least + 2


def test_planted_passages_are_found_and_nothing_else(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    exact, near, short = fresh(51), fresh(90), fresh(30)
    rows, planted = [*ODD], {}
    for i in range(40):
        w = fresh(rng.randrange(20, 150))
        at = rng.randrange(len(w))
        if i % 4 == 0:
            w[at:at] = exact
            planted[100 + i] = "exact"
        elif i % 4 == 1:
            copy = list(near)
            if i > 1:
                copy[rng.randrange(20, 70)] = "changed"
            w[at:at] = copy
            planted[100 + i] = "near"
        elif i % 4 == 2:
            w[at:at] = short
        rows.append((100 + i, " ".join(w), "en", "s"))
    rows += [(7, *ODD[7][1:]), (300, ODD[7][1], "en", "z")]
    found = passages.shared_passages(table(spark, rows)).collect()
    named = {r["doc_id"] for r in found} | {r["other_id"] for r in found}
    assert named == set(planted) | {7, 300}
    texts = {i: t.split() for i, t, *_ in rows if t and i}
    for r in found:
        assert r["similarity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50
        if planted.get(r["doc_id"]) == "exact":
            assert texts[r["doc_id"]][r["start_word"] : r["end_word"]] == exact == texts[r["other_id"]][r["other_start"] : r["other_end"]]
    assert passages.shared_passages(table(spark, rows).limit(0)).collect() == []


def test_passages_between_the_ends_of_large_groups(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    # Frequent lines in all documents, first and last among them: they hold most least values of the passages.
    line = fresh(30)
    rows = [(i, " ".join(fresh(40) + line + fresh(40)), "en", "s") for i in range(1, 80)]
    planted = {}
    for k in range(12):
        exact = fresh(13) + line + fresh(13)
        for i in (100 + 2 * k, 101 + 2 * k):
            rows.append((i, " ".join(fresh(rng.randrange(30, 90)) + exact + fresh(50)), "en", "s"))
            planted[i] = 100 + 2 * k
    rows += [(i, " ".join(fresh(40) + line + fresh(40)), "en", "s") for i in range(200, 280)]
    found = passages.shared_passages(table(spark, rows)).collect()
    assert all(r["similarity"] >= 0.8 for r in found)
    named = {r["doc_id"] for r in found}
    assert named <= set(planted)
    # Seven in ten of the least values are the line's: a function finds a pair by its third value unless all three are.
    assert len(named) >= 20


def test_exact_passages_with_long_frequent_lines_lose_no_document(spark):
    """Nearly all least values lie in a line that very many documents, or one document over and over, hold."""
    rng = random.Random(21)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    line = fresh(45)
    rows = [(i, " ".join(fresh(30) + line + fresh(30)), "en", "s") for i in [*range(1, 40), *range(112, 150), *range(200, 240)]]
    planted = set()
    for k in range(12):
        exact = fresh(3) + line + fresh(3)
        for i in (100 + k, 150 + k):
            rows.append((i, " ".join(fresh(rng.randrange(30, 90)) + exact + fresh(50)), "en", "s"))
            planted.add(i)
    # The centre holds the passage behind more than PART places of the line.
    again = fresh(45)
    last = fresh(3) + again + fresh(3)
    rows.append((300, " ".join(sum([again + fresh(30) for _ in range(20)], []) + last + fresh(30)), "en", "s"))
    rows.append((301, " ".join(fresh(33) + last + fresh(44)), "en", "s"))
    rows.append((302, " ".join(sum([again + fresh(30) for _ in range(20)], [])), "en", "s"))
    found = passages.shared_passages(table(spark, rows)).collect()
    words = {i: t.split() for i, t, *_ in rows}
    assert all(r["similarity"] >= 0.8 for r in found)
    assert planted | {301} <= {r["doc_id"] for r in found} | {r["other_id"] for r in found}
    assert any(words[r["doc_id"]][r["start_word"] : r["end_word"]] == last for r in found if {r["doc_id"], r["other_id"]} == {300, 301})


def test_passages_of_covered_documents_and_near_copies_in_large_groups(spark):
    """What a document shares with one whose stretch lies in another's passage, and near copies that nearly all is frequent in."""
    rng = random.Random(33)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    ends = {i: [] for i in [*range(1, 24), *range(500, 524)]}
    rows, parts, pairs = [], {}, {}
    for k in range(8):
        whole = fresh(200)
        for some in ends.values():
            some += fresh(60) + whole[:100] + fresh(2) + whole[102:]
        # The first is covered by its near copies at the ends; to these the second's 50 words are less alike than 0.8.
        rows.append((100 + k, " ".join(fresh(30) + whole + fresh(30)), "en", "s"))
        rows.append((200 + k, " ".join(fresh(40) + whole[76:126] + fresh(20)), "en", "s"))
        parts[200 + k] = 100 + k
    line = fresh(48)
    for some in ends.values():
        some += fresh(60) + line + fresh(60)
    for k in range(12):
        one = fresh(1) + line + fresh(1)
        other = list(one)
        other[rng.randrange(15, 35)] = "changed"
        rows.append((300 + k, " ".join(fresh(40) + one + fresh(30)), "en", "s"))
        rows.append((400 + k, " ".join(fresh(70) + other + fresh(40)), "en", "s"))
        pairs[300 + k] = 400 + k
    rows += [(i, " ".join(w), "en", "s") for i, w in ends.items()]
    found = passages.shared_passages(table(spark, rows)).collect()
    assert all(r["similarity"] >= 0.8 for r in found)
    met = {frozenset((r["doc_id"], r["other_id"])) for r in found}
    assert all({i, j} in met for i, j in parts.items())
    assert all({i, j} in met for i, j in pairs.items())


def test_passages_keep_less_on_disk_than_their_texts(spark, monkeypatch):
    """Windows of one key are gathered by offset before they travel, and no staged table holds the shingles of the texts."""
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    shared = fresh(400)
    rows = [(i, " ".join(fresh(60) + shared + ["again"] * 200 + fresh(60)), "en", "s") for i in range(1, 60)]
    sizes, plans_ = {}, []

    def kept(df, label, real=passages.stage):
        if label == "near-windows":
            plans_.append(df._jdf.queryExecution().executedPlan().toString())
        staged = real(df, label)
        sizes[label] = sizes.get(label, 0) + sum(f.stat().st_size for f in pathlib.Path(staged.staged_path.removeprefix("file:")).rglob("*.parquet"))
        return staged

    monkeypatch.setattr(passages, "stage", kept)
    found = passages.shared_passages(table(spark, rows)).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 60))
    assert max(sizes.values()) < sum(len(t) for _, t, *_ in rows) / 4
    for plan in plans_:
        travels = re.search(r"Exchange hashpartitioning\(other#.*\n(.*)", plan[plan.rindex("Exchange hashpartitioning(other#") :])
        assert "partial_bit_or" in travels.group(1)


def test_functions_miss_less_than_a_hundredth_at_the_threshold():
    miss = 1 - passages.SIMILARITY
    missed = sum(math.comb(passages.HASHES, k) * (1 - miss) ** k * miss ** (passages.HASHES - k) for k in range(passages.AGREE))
    assert missed < 0.01 and passages.LEAST <= 40


def test_phrases_that_recur_break_no_run():
    rng = np.random.default_rng(11)
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    phrase = fresh(1)
    once = fresh(46)
    once[23] = phrase[0]
    a, b = np.concatenate([fresh(5), phrase, fresh(100), once]), np.concatenate([fresh(90), once, fresh(9)])
    for offset in (-16, 10, -45):
        assert passages.shared_runs(a, b, offset) == [(90, 135, 106, 151, 1.0)]
    line = fresh(6)
    body = np.concatenate([np.concatenate([fresh(24), line]) for _ in range(8)])
    a, b = np.concatenate([line, fresh(70), body]), np.concatenate([fresh(40), body])
    for offset in (-36, -20, -60):
        assert passages.shared_runs(a, b, offset) == [(40, 279, 76, 315, 1.0)]
    same = np.zeros(300, dtype=np.uint64)
    assert passages.shared_runs(same, same[:200], 0)[0][4] == 1.0


def test_a_similar_part_of_an_unlike_run_is_found():
    rng = np.random.default_rng(17)
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    a = fresh(400)
    b = a.copy()
    # Ten places in a row differ at most, so that the whole is one run; only 150 to 202 is similar enough.
    for at in [*range(0, 150, 13), *range(203, 391, 13)]:
        b[at : at + 9] = fresh(9)
    b[174:179] = fresh(5)
    found = passages.shared_runs(a, b)
    assert len(found) == 1 and found[0][0] <= 152 and found[0][1] >= 200 and found[0][4] >= 0.8
    assert found[0][:2] == found[0][2:4]


def test_every_repeated_window_of_a_table_is_reported(spark):
    """All runs of 50 words that two documents of a whole table share, by brute force: what part of them lies in reported passages."""
    words, holders = {}, {}
    for r in documents(spark, FOLDER).collect():
        w = words[r["doc_id"]] = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        for i in range(len(w) - 49):
            holders.setdefault(hash(tuple(w[i : i + 50])), []).append((r["doc_id"], i))
    shared = [x for places in holders.values() if len({d for d, _ in places}) > 1 for x in places]
    reported = {}
    for r in passages.shared_passages(documents(spark, FOLDER)).collect():
        reported.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
        reported.setdefault(r["other_id"], []).append((r["other_start"], r["other_end"]))
    inside = [any(a <= i + 25 < b for a, b in reported.get(d, [])) for d, i in shared]
    assert len(shared) > 1000
    assert np.mean(inside) >= 0.95
    assert np.mean([d in reported for d in {d for d, _ in shared}]) >= 0.95


# vectors

def _nearest(rows, queries, nearest):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i in queries:
            scores = sorted(((-float(q @ v), j) for j, v in ok if j != i and len(v) == len(q)))
            out[i] = [(j, -s) for s, j in scores[:nearest]]
    return out


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 2.0]) for i in range(45)]
    rows += [(200, None), (220, []), (240, [0.0] * 6), (260, [float("nan")] * 6), (280, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [float("inf")] * 6), (None, [1.0] * 6), (320, [1.0, 2.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("clash")).withColumn("id", F.lit("clash"))
    found = vector_graph.nearest_neighbours(docs, vector_graph.index_queries(docs), shard=30).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = {k: v for k, v in _nearest(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20).items() if v}
    assert set(got) == set(expected)
    for k in got:
        assert [x[0] for x in got[k]] == [x[0] for x in expected[k]]
        assert np.allclose([x[1] for x in got[k]], [x[1] for x in expected[k]], rtol=1e-12)
    assert vector_graph.nearest_neighbours(docs.limit(0), docs).collect() == []


def test_recall_on_the_whole_table(spark):
    table_ = documents(spark, FOLDER, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table_.collect()]
    expected = _nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    found = plans.op10_vector_graph(spark, FOLDER).collect()
    hits = sum(r["vec_id"] in {j for j, _ in expected[r["query_id"]]} for r in found)
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_graph_recall_beyond_one_batch():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1500, 32)).astype(np.float32)
    found, _ = vector_graph.Graph(points).search(points[:100])
    exact = np.argsort(((points[:100, None] - points[None]) ** 2).sum(axis=2), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(found, exact)]) > 0.9


def test_recall_on_a_full_shard():
    """As many points as a registered shard holds, unit vectors around centres."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(40, 64))
    points = centres[rng.integers(40, size=vector_graph.SHARD)] + rng.normal(size=(vector_graph.SHARD, 64)) * 1.5
    points /= np.linalg.norm(points, axis=1)[:, None]
    asked = points[:400]
    graph = vector_graph.Graph(points)
    found = np.concatenate([graph.search(asked[i : i + 200])[0] for i in (0, 200)])
    exact = np.argsort(-(asked @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(found, exact)]) > 0.9


def test_recall_on_full_shards_of_varied_lengths(spark):
    rng = np.random.default_rng(14)
    points = rng.normal(size=(3000, 16)) * np.exp(rng.normal(size=(3000, 1)) / 4)
    points[7] *= 1e4
    points[11] *= 1e25
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = docs.where("vec_id % 20 = 0")
    found = vector_graph.nearest_neighbours(docs, asked, shard=500).collect()
    expected = _nearest(rows, set(range(0, 3000, 20)), 20)
    hits = sum(r["vec_id"] in {j for j, _ in expected[r["query_id"]]} for r in found)
    assert hits >= 0.9 * sum(map(len, expected.values()))


# pipeline

def test_near_copies_go_by_five_words_and_by_row(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    one, other, last = fresh(100), fresh(100), fresh(100)
    edited = [f"n{i}" if i % 20 == 10 else w for i, w in enumerate(one)]
    rows = [(1, " ".join(one)), (2, " ".join(edited)), (3, " ".join(one)), (3, " ".join(other)), (4, " ".join([*one[:99], "new"])),
            (5, " ".join(last)), (5, " ".join(last)), (6, None), (7, ""), (None, " ".join(one))]
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    kept = corpus_pipeline.near_duplicates(spark, docs, None)
    assert kept.columns == docs.columns
    expected = [x for k, x in enumerate(rows) if k not in (2, 4)]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in expected)


def test_every_stage_keeps_the_columns_of_documents(spark):
    docs = documents(spark, FOLDER)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert docs.count() > 0


# Each stage alone, on rows that a corpus may hold.

CLASH = ("_id", "_nodes", "_node", "_language", "_secrets", "_key", "_row", "_parts", "_units", "_whole", "row", "size", "line", "quality", "id", "ids")
STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def _stage_rows():
    rng = random.Random(12)
    prose = lambda: " ".join(rng.choice(["the", "mountain", "river", "house", "and", "walked", "blue", "slowly", "over"]) for _ in range(80))
    plain = [(i, prose(), "en", f"s{i % 3}") for i in range(30)]
    rows = [*plain, *ODD, (40, plain[0][1], "en", "s9"), (41, plain[1][1] + " end", None, "s9"), (42, "key is token=Zk3v9XpQ7LmT2 here and more words", "en", None)]
    return [(i, t, lang, s, len(t) if t else None, *[f"{c}{k}" for c in CLASH]) for k, (i, t, lang, s) in enumerate(rows)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_pipeline_stages_keep_columns_and_take_odd_rows(spark, name, stage):
    rows = _stage_rows()
    docs = spark.createDataFrame(rows, STAGE_SCHEMA)
    out = stage(spark, docs, None)
    assert out.schema.names == docs.schema.names
    found = out.collect()
    given = {tuple(r[5:]): r for r in rows}
    for r in found:  # other columns stay with their row
        own = given[tuple(r[c] for c in CLASH)]
        assert (r["doc_id"], r["lang"], r["source"]) == (own[0], own[2], own[3])
    ids = {tuple(r[c] for c in CLASH) for r in found}
    gone = [r for k, r in given.items() if k not in ids]
    texts = {r["doc_id"]: r["text"] for r in found}
    if name == "languages":
        assert {r[0] for r in gone} >= {1, 2, 3} and not {r[0] for r in gone} & set(range(4, 31)) - {4, 5, 8}
    elif name == "near_duplicates":
        assert {r[0] for r in gone} == {40, 41}
    elif name == "secrets":
        assert not gone and "Zk3v9XpQ7LmT2" not in texts[42] and texts[20] == rows[20][1]
        assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in found)
    else:
        assert all(r["text"] in (t := given[tuple(r[c] for c in CLASH)][1]) or set(r["text"].split()) <= set(t.split()) for r in found)
    empty = stage(spark, docs.limit(0), None)
    assert empty.schema.names == docs.schema.names and empty.count() == 0


def test_last_stage_takes_odd_rows(spark):
    docs = spark.createDataFrame(_stage_rows(), STAGE_SCHEMA)
    found = corpus_pipeline.sequences(spark, docs, None).collect()
    _check_packing(spark, [r[:4] for r in _stage_rows()], found)
    assert corpus_pipeline.sequences(spark, docs.limit(0), None).count() == 0
