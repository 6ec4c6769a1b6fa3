"""Text-file sources with explicit schemas, and row keys for files without one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordered import sums_before

# Column names and types of the files read.
LISTING_COLUMNS = ["title", "href", "city", "timestamp", "description"]
LONG_LISTING_COLUMNS = ["title", "href", "city", "timestamp", "full_description"]
PRICE_SCHEMA = (
    "Timestamp bigint, Open double, High double, Low double, Close double, "
    "`Volume_(BTC)` double, `Volume_(Currency)` double, Weighted_Price double"
)

# Quotes are ordinary characters in these files.
TSV = {"sep": "\t", "quote": "", "escape": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_tsv(spark: SparkSession, path: str | list[str], columns: list[str], header: bool = True) -> DataFrame:
    """A TSV file, or several one after another, all fields strings; an empty field is ''."""
    df = spark.read.schema(_strings(columns)).csv(path, header=header, **TSV)
    return df.na.fill("")


def read_listings(spark: SparkSession, path: str | list[str], full_description: bool = False) -> DataFrame:
    """Listing rows of TSV files with a header."""
    return read_tsv(spark, path, LONG_LISTING_COLUMNS if full_description else LISTING_COLUMNS)


def read_field(spark: SparkSession, path: str, index: int = 2) -> DataFrame:
    """``(text)``: one field, by position from 0, of a TSV file without header."""
    lines = spark.read.text(path)
    return lines.select(F.get(F.split("value", "\t"), F.lit(index)).alias("text"))


def read_ratings(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """``(item, rating)`` of a two-column TSV file without header."""
    df = spark.read.schema(_strings(["item", "rating"])).csv(path, **TSV)
    item = F.trim("item") if strip else F.col("item")
    return df.select(item.alias("item"), F.trim("rating").cast("int").alias("rating"))


def read_prices(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """Minute price bars of a CSV file with header; NaN is NULL, ``ts`` is the time in UTC."""
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    df = reader.csv(path, inferSchema=True) if infer else reader.schema(PRICE_SCHEMA).csv(path)
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    nulled = {n: F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in doubles}
    return df.withColumns(nulled).withColumn("ts", F.timestamp_seconds("Timestamp"))


def number_lines(df: DataFrame, start: int = 0, name: str = "line") -> DataFrame:
    """Number the rows of a file scan in file order.

    A row's number within its split follows from Spark's increasing ids; the lengths of the splits before it are added
    up over ranges of splits, and joined to the rows. As long as the list of splits is below the broadcast threshold the
    rows stay where they are.
    """
    block = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
    tagged = df.select("*", *[c.alias(n) for n, c in block.items()])
    tagged = tagged.withColumn("_row", F.monotonically_increasing_id())
    splits = tagged.groupBy(*block).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = sums_before(splits, list(block), "_n", "_lines").select(*block, "_first", "_lines")
    joined = tagged.join(offsets, list(block))
    number = F.col("_lines") + F.col("_row") - F.col("_first") + F.lit(start)
    return joined.withColumn(name, number).drop(*block, "_row", "_first", "_lines")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, by column name, duplicates kept."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
