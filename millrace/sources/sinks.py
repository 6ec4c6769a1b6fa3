"""Writers: TSV files, search indexes, stored results of expensive operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import clean, escape_field
from millrace.operators.skew import part_of, parts_of


def write_tsv(df: DataFrame, path: str, columns: list[str], header: bool = True) -> None:
    """Write string columns in the given order; tabs and line breaks in fields become blanks."""
    fields = [escape_field(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]
    df.select(*fields).write.csv(path, sep="\t", header=header, quote="", escape="", emptyValue="")


def clean_listings(listings: DataFrame, keep: list[str] = ["title", "city", "description"]) -> DataFrame:
    """The kept columns, in the order of the input's columns, cleaned for search."""
    return listings.select(*[clean(F.col(c)).alias(c) for c in listings.columns if c in keep])


def write_index(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store postings ordered by term, so that a term's lookup reads few row groups.

    Ranges run over (term, document): a term of very many postings fills several files.
    """
    ordered = postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    ordered.write.mode(mode).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Postings stored by :func:`write_index`."""
    return spark.read.parquet(path)


def nested_postings(postings: DataFrame, per_line: int = 100_000) -> DataFrame:
    """``(term, part, entries)``: postings as arrays by document; long ones are cut into parts."""
    return _nested(_cut(postings, per_line))


def _cut(postings: DataFrame, per_line: int) -> DataFrame:
    part = part_of(F.col("doc_id"), parts_of(F.col("df"), per_line))
    return postings.select("term", part.alias("part"), "doc_id", "partial_score")


def _nested(cut: DataFrame) -> DataFrame:
    entry = F.struct("doc_id", "partial_score")
    return cut.groupBy("term", "part").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def write_readable_index(postings: DataFrame, path: str, per_line: int = 100_000) -> None:
    """Text lines ``term<TAB>entries`` in term order, several lines for a term of many postings, in files packed by gzip.

    Postings are dealt by ranges of lines before they are gathered, so that they are shuffled once.
    """
    nested = _nested(_cut(postings, per_line).repartitionByRange("term", "part"))
    line = F.concat_ws("\t", "term", F.to_json("entries"))
    nested.sortWithinPartitions("term", "part").select(line.alias("value")).write.text(path, compression="gzip")


def fingerprint(df: DataFrame) -> str:
    """A digest of the names, sizes and times of change of the files that a frame reads."""
    spark = df.sparkSession
    digest = hashlib.md5()
    for name in sorted(df.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        digest.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()


def stored(
    spark: SparkSession, folder: str, name: str, parameters: dict, build: Callable[[], DataFrame],
    refresh: bool = False, source: DataFrame | None = None,
) -> DataFrame:
    """A result kept on disk under its name and all its parameters; built on first use.

    With ``source``, the frame that it is made of, the files behind that are part of the key: new input is a new result.
    """
    known = parameters | ({} if source is None else {"input": fingerprint(source)})
    key = "_".join(f"{k}-{known[k]}" for k in sorted(known))
    path = f"{folder}/{name}_{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if refresh or not exists:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
