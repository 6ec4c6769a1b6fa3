"""A document pipeline: language, near-duplicates, secrets, mixture, packing.

Each stage takes a table with the columns of ``documents`` and all but the last return one. Null and repeated rows, ties
and empty tables are handled as the operators' own descriptions say.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import language_id, minhash_dedup, mixing, packing, secret_scan
from millrace.llm.common import documents, unused
from millrace.llm.tokens import tokenizer_path
from millrace.session import stage as stored

#: Bits per byte of the uniform code: a text that no learned language codes in fewer is in none of them.
UNIFORM_BITS = 8
#: Words of a shingle of near-duplicates: with two, scattered edits and chains of them would delete too much.
SHINGLE = 5


def languages(spark, docs, sf_dir):
    """Drop documents in no learned language: no letter, or no shorter code than the uniform one. Null texts go; without
    labelled rows no language is learned and all go."""
    name = unused(docs, "_language")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model, column=name)
    known = (F.col(f"{name}.lang_pred") != language_id.UNDETERMINED) & (F.col(f"{name}.bits_per_byte") < UNIFORM_BITS)
    return found.where(known).drop(name)


def near_duplicates(spark, docs, sf_dir):
    """Keep one document of each group of near copies, the one of the smallest id; a row goes by its id and its text. Rows
    equal in both, without a word or without an id stay."""
    held, nodes, node = (unused(docs, f"_{x}") for x in ("id", "nodes", "node"))
    found = minhash_dedup.near_duplicates(docs, words=SHINGLE, digests=True)
    copies = found.where(~F.col("kept")).groupBy(F.col("id").alias(held)).agg(F.collect_set("node").alias(nodes))
    joined = docs.join(copies, docs["doc_id"] == copies[held], "left")
    own = minhash_dedup.digest(F.when(F.col(nodes).isNotNull(), F.col("text")), SHINGLE)
    removed = F.coalesce(F.array_contains(nodes, F.col(node)), F.lit(False))
    return joined.withColumn(node, own).where(~removed).drop(held, nodes, node)


def secrets(spark, docs, sf_dir):
    """Replace secrets by a mark; every document stays. ``n_chars`` follows the text."""
    name = unused(docs, "_secrets")
    found = secret_scan.scan(docs, column=name)
    text = secret_scan.redacted(F.col("text"), F.col(name))
    return _with_length(found.withColumn("text", text)).drop(name)


def mixture(spark, docs, sf_dir):
    """The sources' target weights: a row per document and pass, with the words that the mix takes."""
    return _with_length(mixing.mixed_documents(docs))


def sequences(spark, docs, sf_dir):
    """Training sequences of 2048 ids, with the ids."""
    return packing.packed(docs, tokenizer_path(), with_ids=True)


def _with_length(docs):
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


STAGES = [
    ("languages", languages), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("sequences", sequences),
]
#: Language models, hashed signatures and a tokenizer have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each over the stored result of the one before."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
