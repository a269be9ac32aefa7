"""Frequencies over live event streams with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import blocks_before
from tessera.sources.shared import Shared


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder (or file) of Parquet events as a stream, some files to a batch."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return stream.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return stream.parquet(path)


def block_counts(events: DataFrame, size: int) -> DataFrame:
    """Running ``(blk, key, n)`` of a stream with ``seq`` and ``key``: the jumping window's state."""
    return events.groupBy(F.expr(f"seq div {size}").alias("blk"), "key").agg(F.count(F.lit(1)).alias("n"))


def block_terms(events: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """Running ``(key, blk, t, n)`` of a stream with ``seq`` and ``key`` for fixed ``queries(t, key)``.

    With a null t: events of the key in a block; else those of the query's own block up to t.  An
    event meets only the queries of its own key and block, so a hot key costs no more than others,
    and the state is a row for each query and each (key, block).
    """
    blk = F.expr(f"t div {size}")
    asked = queries.select("t", F.col("key").alias("q_key")).distinct().groupBy("q_key", blk.alias("q_blk")).agg(F.collect_list("t").alias("ts"))
    marked = events.withColumn("blk", F.expr(f"seq div {size}"))
    met = marked.join(asked, (F.col("key") == F.col("q_key")) & (F.col("blk") == F.col("q_blk")), "left")
    each = F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.coalesce(F.expr("filter(ts, t -> t >= seq)"), F.expr("array()")))).alias("t")
    return met.select("key", "blk", each).groupBy("key", "blk", "t").agg(F.count(F.lit(1)).alias("n"))


def point_frequency(terms: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """``queries(t, key)`` with ``n``, the events of the key up to t, from the latest ``block_terms``."""
    asked = queries.select("t", "key").distinct().withColumn("id", F.struct("t", "key")).withColumn("blk", F.expr(f"t div {size}"))
    sums = terms.where("t IS NULL").select("key", "blk", F.col("n").alias("x"))
    before = blocks_before(sums, asked.select("key", "blk", "id"), size, F.sum, F.sum("x"))
    inside = terms.where("t IS NOT NULL").select(F.struct("t", "key").alias("id"), F.col("n").alias("x"))
    total = before.unionByName(inside).groupBy("id").agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n"))
    return total.select("id.t", "id.key", "n")


def window_frequency(events: DataFrame, queries: DataFrame) -> DataFrame:
    """Running counts ``(t, key, w, n)`` of the events in (t - w, t] for fixed ``queries(t, key, w)``.

    A stream-static join: an event meets the queries whose windows hold it, and the state is a row
    for each query.  Queries without events have no row.
    """
    q = queries.select("t", F.col("key").alias("q_key"), "w").distinct()
    return events.join(q, (F.col("key") == F.col("q_key")) & (F.col("seq") <= F.col("t")) & (F.col("seq") > F.col("t") - F.col("w"))).groupBy("t", "key", "w").agg(F.count(F.lit(1)).alias("n"))


def run_available(result: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a complete-mode query over all input there is; returns its last table.

    Each micro-batch writes a folder of its own, which the next one replaces only once it is written.
    """
    shared, last = Shared(spark, name), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{shared.path}/table-{number}")
        last.append(number)
        for old in last[:-1]:
            shared.drop(f"table-{old}")
        del last[:-1]

    writer = result.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{shared.path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(f"{shared.path}/table-{last[-1]}")
