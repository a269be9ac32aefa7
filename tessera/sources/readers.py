"""Scans: tables, delimited files with declared schemas, event streams and query files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"Integer": T.IntegerType(), "Float": T.FloatType(), "String": T.StringType()}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def declared_schema(text: str) -> T.StructType:
    """``name:Type,name:Type`` with Integer, Float and String; any other type or a repeat raises."""
    fields = []
    for part in text.split(","):
        name, colon, kind = (x.strip() for x in part.partition(":"))
        if not colon or not name or kind not in TYPES:
            raise ValueError(f"not a column declaration: {part!r}")
        if name in (f.name for f in fields):
            raise ValueError(f"declared twice: {name}")
        fields.append(T.StructField(name, TYPES[kind]))
    return T.StructType(fields)


def delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """A file without header under a declared schema; a row that doesn't fit it raises when read."""
    kind = declared_schema(schema) if isinstance(schema, str) and ":" in schema else schema
    return spark.read.csv(path, schema=kind, sep=sep, header=False, mode="FAILFAST", quote="")


def with_sequence(rows: DataFrame, name: str = "seq") -> DataFrame:
    """Number the rows of a scan from 0: files in the order of their paths, rows as they stand in them.

    Each split of a file is counted, and starts after those before it: no row moves to number it.
    Rows that come from no file are numbered in the order of their partitions.  The input must read
    the same twice, as files do.
    """
    at = F.monotonically_increasing_id().alias("_at")
    try:
        marked = rows.select("*", at, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    except AnalysisException:
        marked = rows.select("*", at).withColumn("_file", F.lit("")).withColumn("_start", F.shiftright("_at", 33))
    sizes = marked.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    order = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(order), F.lit(0))
    starts = sizes.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), (before - F.col("_first")).alias("_shift"))
    joined = marked.join(F.broadcast(starts), (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))  # a row for each split
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def events(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated events: column 0 is the address; ``seq`` counts lines that aren't blank."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return with_sequence(rows.select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("ip")))


def point_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``time ip [window]``; without a window it is 0, which stands for the default."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(part.alias("p"))
    return rows.select(F.col("p")[0].cast("bigint").alias("time"), F.col("p")[1].alias("ip"), F.coalesce(F.get("p", F.lit(2)).cast("bigint"), F.lit(0)).alias("window"))


def range_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``ip_lo ip_hi`` with an ``id`` that counts them."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(part[0].alias("ip_lo"), part[1].alias("ip_hi"))
    return with_sequence(rows, "id")


def tuples(spark: SparkSession, path: str) -> DataFrame:
    """``price|age`` lines."""
    return delimited(spark, path, "price INT, age INT", sep="|")


def inline_relations(spark: SparkSession, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """R(2i, 3i) and S(3i, 4i) for i below ``n``."""
    ids = spark.range(n)
    return ids.selectExpr("2 * id AS a", "3 * id AS b"), ids.selectExpr("3 * id AS b", "4 * id AS c")
