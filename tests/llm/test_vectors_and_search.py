"""Whitening, SentencePiece coding and ranked search against libraries and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lexical_search, plans, sentence_pieces, whitening
from millrace.llm.common import documents
from millrace.llm.tokens import tokenizer_path

FOLDER = "/root/testdata/sf0.001"
PIECES = tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   \n\t ", "word", "Hello  world", "é ü 漢字 \U0001f600 \U0010ffff x\0", "<s> </s> <0x41> <unk> ▁ ▁▁x", "a" * 3000,
    " " * 500 + "the end" + " " * 33, "no-blanks-" * 2000, "日本語の中国" * 500, "words in a long text " * 9000, "word", "İ ǆ ß",
]


# SentencePiece

@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(library):
    rng = random.Random(3)
    own = sentence_pieces.coder(PIECES)
    texts = [t or "" for t in TEXTS]
    for alphabet in ("ab", "etaoin shrdlu", "aA0 ▁\n.", "   a", "éèà ßö", "日本語の中国 ", "0123456789abcdef", "inertherationsable"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 3, 10, 40, 200, 700]))) for _ in range(80)]
    plain = [library.id_to_piece(i).strip("▁") for i in range(300, library.get_piece_size())]
    texts += ["".join(rng.choice(plain) for _ in range(rng.choice([5, 30, 200]))) for _ in range(200)]
    texts += [" " * i + x + " " * j for i in range(0, 70, 3) for x in ("", "the", "9") for j in (0, 1, 40)]
    for _ in range(2):  # the second time from what is remembered
        for t, ids in zip(texts, own.encode(texts)):
            assert ids.tolist() == library.encode(t), t[:80]
            assert own.decode(ids) == library.decode(ids.tolist())


def test_decoding_any_ids_equals_the_library(library):
    rng = random.Random(4)
    own = sentence_pieces.coder(PIECES)
    for low, high in ((0, library.get_piece_size()), (3, 259)):
        for _ in range(300):
            ids = [rng.randrange(low, high) for _ in range(12)]
            assert own.decode(np.array(ids)) == library.decode(ids)


def test_symbol_table_finds_what_it_holds():
    rng = random.Random(5)
    values = {rng.randrange(1 << 50): i for i in range(5000)}
    table = sentence_pieces._Table(values)
    keys = np.array([*values, *[rng.randrange(1 << 50) for _ in range(5000)]])
    assert table.find(keys).tolist() == [values.get(k, -1) for k in keys.tolist()]


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        sentence_pieces.Coder(str(tmp_path / "none.model"))


def test_piece_columns_on_odd_rows(spark, library):
    rows = [(i, t, "kept", 1) for i, t in enumerate(TEXTS)] + [(None, "x y", None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = sentence_pieces.encoded(table, PIECES)
    assert found.columns == ["doc_id", "n_tokens", "ids"]
    found = {r["doc_id"]: r for r in sentence_pieces.decoded(found, PIECES).collect()}
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        assert found[i]["ids"] == ids and found[i]["text"] == library.decode(ids)
    empty = sentence_pieces.decoded(sentence_pieces.encoded(table.limit(0), PIECES), PIECES)
    assert empty.count() == 0


def test_op12_on_the_table(spark, library):
    found = {r["doc_id"]: r for r in plans.op12_sentence_pieces(spark, FOLDER).collect()}
    rows = documents(spark, FOLDER).collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert found[r["doc_id"]].asDict() == {
            "doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": digest(",".join(map(str, ids))),
            "decoded_sha256": digest(library.decode(ids)),
        }


# Whitening

def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = rng.integers(1, 12)
        a = rng.standard_normal((n, n))
        a = np.round(a + a.T) if rng.random() < 0.5 else a + a.T
        shift = rng.standard_normal()
        assert whitening.inertia(a, shift) == (np.linalg.eigvalsh(a) < shift).sum()


@pytest.mark.parametrize("kind", ["random", "flat", "identity", "equal", "close", "closer", "falling", "zero", "one"])
def test_eigenpairs_are_numbered_and_orthogonal(kind):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    wide = rng.standard_normal((300, 40))
    values = {"equal": np.repeat(np.arange(1.0, 9), 5), "close": 1 + 1e-8 * np.arange(40), "closer": 1 + 1e-11 * np.arange(40),
              "falling": 10.0 ** -np.arange(40)}
    if kind in values:
        matrix = (basis * values[kind]) @ basis.T
        matrix = (matrix + matrix.T) / 2
    else:
        matrix = {"random": np.cov(wide.T), "flat": np.cov(wide[:12].T), "identity": 3 * np.eye(40), "zero": np.zeros((5, 5)), "one": np.ones((1, 1))}[kind]
    found, vectors = whitening.leading_eigenpairs(matrix, 32)
    expected = np.linalg.eigvalsh(matrix)[::-1]
    assert len(found) == min(32, (expected > whitening.ZERO * max(expected[0], 1e-300) * 10).sum()) or kind == "falling" and len(found) >= 10
    assert np.abs(found - expected[: len(found)]).max(initial=0) <= 1e-13 * max(1, expected[0])
    assert np.abs(matrix @ vectors - vectors * found).max(initial=0) <= 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max(initial=0) <= 1e-12


def _whitened_by_numpy(vectors, many):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    z = x - total / n
    v = z.T @ z / n
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1][:many], columns[:, ::-1][:, :many]
    return n, ((n * x - total) ** 2).sum(axis=1), z @ columns / np.sqrt(values), values / np.trace(v)


def _check_whitening(rows, ids, vectors, many=32):
    n, deviation, projected, explained = _whitened_by_numpy(vectors, many)
    by_component = {}
    for r in rows:
        by_component.setdefault(r["component"], {})[r["id"]] = r
    assert sorted(by_component) == list(range(1, min(many, len(vectors[0])) + 1))
    for c, own in by_component.items():
        got = np.array([own[i]["whitened"] for i in ids])
        sign = np.sign((got * projected[:, c - 1]).sum())
        assert np.abs(got * sign - projected[:, c - 1]).max() < 1e-6
        for k, i in enumerate(ids):
            assert own[i]["n"] == n and own[i]["deviation"] == deviation[k]
            assert abs(own[i]["explained"] / explained[c - 1] - 1) < 1e-10 and own[i]["identity_error"] < 1e-8


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((300, 6)) * [9, 5, 3, 2, 1, 0.5] + [0, 1e6, -5e7, 0, 3, 0]).tolist()
    odd = [(None, None), (900, None), (901, [1.0] * 5 + [float("nan")]), (902, [1.0] * 5 + [None]), (903, [float("inf")] * 6), (904, []), (905, [1e30] * 6)]
    table = spark.createDataFrame([*enumerate(vectors), *odd], "vec_id long, embedding array<double>")
    rows = whitening.whitened(table).collect()
    _check_whitening(rows, list(range(300)), vectors)
    rows = whitening.whitened(table, many=2).collect()
    _check_whitening(rows, list(range(300)), vectors, 2)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, id string"
    made = lambda rows: whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    assert made([]) == [] and made([(1, [1.0, 2.0], "a")]) == [] and made([(1, [1.0, 2.0], "a")] * 5) == []
    # One direction of spread, repeated rows, a null id, and vectors of a second dimension with a fit of their own.
    rows = [(1, [0.0, 0.0], "a"), (1, [0.0, 0.0], "a"), (None, [1.0, 1.0], "a"), (2, [1.0, 1.0], "a"), (7, [3.0], "b"), (8, [5.0], "b")]
    found = made(rows)
    assert sorted((r["id"] is None, r["id"] or 0, r["component"], r["n"]) for r in found) == [
        (False, 1, 1, 4), (False, 1, 1, 4), (False, 2, 1, 4), (False, 7, 1, 2), (False, 8, 1, 2), (True, 0, 1, 4)]
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 and abs(r["explained"] - 1) < 1e-12 for r in found)
    far = made([(1, [2.0**43], "a"), (2, [-(2.0**43)], "a")])
    assert [r["deviation"] for r in far] == [None, None] and all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in far)


def test_op11_on_the_table(spark):
    rows = [r.asDict() | {"id": r["vec_id"]} for r in plans.op11_whitening(spark, FOLDER).collect()]
    table = documents(spark, FOLDER, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).collect()
    _check_whitening(rows, [r["vec_id"] for r in table], [r["e"] for r in table])


# Ranked search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return _TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if text else []


def _ranked(docs, items, nearest=10):
    bags = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        asked = [(w, math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1)))) for w in set(_terms(text)) if w in df]
        scores = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * count // total
            scores.append((sum(w * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, w in asked), i))
        best = sorted((-s, i is None, i or 0) for s, i in scores if s > 0)[:nearest]
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(best)]
    return sorted(out, key=repr)


def _found(spark, docs, items, **how):
    blocks = lexical_search.index(spark.createDataFrame(docs, "doc_id long, text string, id string, words string"))
    found = lexical_search.search(blocks, spark.createDataFrame(items, "item_id long, text string, item string"), **how)
    return sorted([tuple(r) for r in found.collect()], key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 60)
    monkeypatch.setattr(lexical_search, "CELLS", 1 << 10)
    monkeypatch.setattr(lexical_search, "DOCUMENTS", 50)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(400)]
    docs += [(i + 1000, docs[7][1]) for i in range(60)]  # more equal scores than places
    docs += [(7, docs[7][1]), (None, docs[7][1]), (None, "w1 w2"), (500, None), (501, ""), (502, "... !\n"), (503, "É É漢 W1-w2_x")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20])))) for i in range(40)]
    items += [(41, docs[7][1]), (42, None), (43, "nowhere"), (44, "É 漢 é漢 É漢 X"), (45, ""), (None, "w3 w2")]
    full = lambda rows: [(i, t, "x", None) for i, t in rows]
    expected = _ranked(docs, items)
    assert _found(spark, full(docs), [(i, t, "y") for i, t in [*items, items[0]]]) == expected
    assert _found(spark, full(docs), [(i, t, "y") for i, t in items], nearest=3) == _ranked(docs, items, 3)


def test_search_of_odd_tables(spark):
    item, doc = [(1, "a b", "y")], [(1, "a b", None, None)]
    assert _found(spark, [], item) == [] and _found(spark, doc, []) == [] and _found(spark, [(1, None, None, None)], item) == []
    # Every document holds the term: its weight is 0, and so are all scores.
    assert _found(spark, doc, [(1, "a", "y")]) == _ranked([(1, "a b")], [(1, "a")])
    long = [(i, "tail " * 200_000 + f"head{i}" if i == 3 else f"head{i} tail", None, None) for i in range(30)]
    asked = [(1, "head3 tail", "y"), (2, "head4", "y")]
    assert _found(spark, long, asked) == _ranked([r[:2] for r in long], [r[:2] for r in asked])


def test_signatures_never_miss_and_skip_most(spark):
    """Bounds are at least the scores, so nothing is lost; they are close enough to leave most documents out."""
    docs = documents(spark, FOLDER)
    row = lexical_search.index(docs.coalesce(1)).orderBy(F.desc("documents")).first()
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    bits = np.unpackbits(np.frombuffer(unpack(row["signature"]), dtype=np.uint8).reshape(row["height"], -1), axis=1)
    texts = {r["doc_id"]: Counter(_terms(r["text"])) for r in docs.collect()}
    hashes = lexical_search._hashes([w.encode() for w in row["words"]])
    said = missing = 0
    for k, least in enumerate(lexical_search.LEVELS[:3]):
        admitted = bits[lexical_search._positions(hashes, k, row["height"])].min(axis=1)
        for d, i in enumerate(row["ids"]):
            has = np.array([texts[i][w] >= least for w in row["words"]])
            assert admitted[has, d].all()
            said += admitted[~has, d].sum()
            missing += (~has).sum()
    assert said / missing < 0.02
