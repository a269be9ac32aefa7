"""Equi-joins with and without reduction, and as-of questions over ordered keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def semi_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str) -> DataFrame:
    """Rows of ``probe`` whose key occurs in ``build``, each once.  Only keys of ``build`` move."""
    return probe.join(build.select(F.col(build_key).alias("_key")), probe[probe_key] == F.col("_key"), "left_semi")


def repartition_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, how: str = "inner") -> DataFrame:
    """Both sides hashed on the key, hash tables built from the (smaller) build side of each partition."""
    return probe.join(build.hint("shuffle_hash"), probe[probe_key] == build[build_key], how)


def copartitioned(left: DataFrame, right: DataFrame, key: str, partitions: int) -> tuple[DataFrame, DataFrame]:
    """Both sides hashed alike, so that later joins on the key need no further shuffle."""
    return left.repartition(partitions, key), right.repartition(partitions, key)


def bucket_filter(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """One-hash Bloom filter of a key as the relation of its set bits; negative keys hash too."""
    return keys.select(F.pmod(F.col(key), F.lit(buckets)).alias("bit")).distinct()


def reduced(rows: DataFrame, key: str, bits: DataFrame, buckets: int) -> DataFrame:
    """The rows whose bit is set: all that can match, and some that don't."""
    return rows.join(bits, F.pmod(rows[key], F.lit(buckets)) == bits["bit"], "left_semi")


def bloom_join(r: DataFrame, s: DataFrame, key: str = "b", buckets: int = 10_000) -> DataFrame:
    """Natural join with every pair kept, after S is reduced by R's filter (at most ``buckets`` bits)."""
    bits = bucket_filter(r, key, buckets)
    return r.join(reduced(s, key, F.broadcast(bits), buckets), key)


def reduction_stats(r: DataFrame, s: DataFrame, key: str = "b", buckets: int = 10_000) -> DataFrame:
    """One row: bits set, rows of S with and without reduction, rows that take part, and the bytes
    each side sends: R its filter, S each key once (8 bytes) with its values (8 bytes each)."""
    bits = bucket_filter(r, key, buckets)
    left = bits.agg(F.count(F.lit(1)).alias("bits_set"))
    sent = reduced(s, key, F.broadcast(bits), buckets).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows, keys = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    mid = sent.agg(rows.alias("rows_shipped"), F.lit(-(-buckets // 8)).cast("bigint").alias("bytes_from_r"), (8 * (rows + keys)).alias("bytes_from_s"))
    exact = s.join(r.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("rows_matching"))
    whole = s.agg(F.count(F.lit(1)).alias("rows_total"))
    return left.crossJoin(mid).crossJoin(exact).crossJoin(whole)  # four single rows


def grouped_values(s: DataFrame, key: str = "b", value: str = "c") -> DataFrame:
    """Each key with the sorted list of its values."""
    return s.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def blocks_before(parts: DataFrame, marks: DataFrame, block: int, fold, merge) -> DataFrame:
    """``(id, x)``, two rows for each mark: what ``fold`` makes of ``parts(key, blk, x)`` before it.

    One row comes from the blocks of the mark's own run of ``block`` blocks, the other from whole
    runs before it, each merged to one row first, so that neither window holds a key's history.
    """
    parts, marks = (f.withColumn("run", F.floor(F.col("blk") / F.lit(block)).cast("bigint")) for f in (parts, marks))
    nothing = F.lit(None).cast(parts.schema["x"].dataType)
    none = F.lit(None).cast(marks.schema["id"].dataType)
    inner = parts.select("key", "run", "blk", "x", none.alias("id")).unionByName(marks.select("key", "run", "blk", nothing.alias("x"), "id"))
    order = Window.partitionBy("key", "run").orderBy("blk").rangeBetween(Window.unboundedPreceding, -1)
    near = inner.withColumn("x", fold("x").over(order)).where("id IS NOT NULL").select("id", "x")
    runs = parts.groupBy("key", "run").agg(merge.alias("x"))
    outer = runs.select("key", "run", "x", none.alias("id")).unionByName(marks.select("key", "run", nothing.alias("x"), "id"))
    order = Window.partitionBy("key").orderBy("run").rangeBetween(Window.unboundedPreceding, -1)
    return near.unionByName(outer.withColumn("x", fold("x").over(order)).where("id IS NOT NULL").select("id", "x"))


def count_terms(events: DataFrame, points: DataFrame, block: int) -> DataFrame:
    """``(id, x)`` rows whose sum for each id is the count of the point's key up to its ``seq``.

    ``events(key, seq)``, ``points(id, key, seq)`` with unique ids of any type; a negative seq
    counts none, and every id has a row.  Events are counted by (key, block of seq), running sums
    over these counts give the blocks before a point's, and an equi-join on (key, block) the rest.
    No key's events meet in one task, only its blocks do, and no point meets more than one block
    of events.
    """
    blk = F.floor(F.col("seq") / F.lit(block)).cast("bigint")
    marked = events.select("key", "seq", blk.alias("blk"))
    at = points.select("id", "key", F.col("seq").alias("p_seq"), blk.alias("blk"))
    sums = marked.groupBy("key", "blk").agg(F.count(F.lit(1)).alias("x"))
    before = blocks_before(sums, at.select("key", "blk", "id"), block, F.sum, F.sum("x"))
    inside = at.join(marked, ["key", "blk"]).where("seq <= p_seq").select("id", F.lit(1).cast("bigint").alias("x"))
    return before.select("id", F.coalesce("x", F.lit(0).cast("bigint")).alias("x")).unionByName(inside)


def counts_up_to(events: DataFrame, points: DataFrame, block: int) -> DataFrame:
    """``(id, n)``: how many events of a point's key have ``seq`` up to the point's (see ``count_terms``)."""
    return count_terms(events, points, block).groupBy("id").agg(F.sum("x").alias("n"))


def as_of(points: DataFrame, versions: DataFrame, block: int) -> DataFrame:
    """``points(id, key, seq)`` with ``(wts, value)`` of the key's latest version up to seq, or nulls.

    The same levels as ``count_terms``: the latest version of each (key, block), carried forward,
    and an equi-join within the point's own block.
    """
    held = versions.select("key", "wts", "value", F.floor(F.col("wts") / F.lit(block)).cast("bigint").alias("blk"))
    at = points.select("id", "key", "seq", F.floor(F.col("seq") / F.lit(block)).cast("bigint").alias("blk"))
    pair = F.struct("wts", "value")
    last = held.groupBy("key", "blk").agg(F.max_by(pair, "wts").alias("x"))
    carried = blocks_before(last, at.select("key", "blk", "id"), block, lambda c: F.last(c, ignorenulls=True), F.max_by("x", "blk"))
    inside = at.join(held, ["key", "blk"]).where("wts <= seq").select("id", pair.alias("x"))
    found = carried.where("x IS NOT NULL").unionByName(inside).groupBy("id").agg(F.max_by("x", "x.wts").alias("found"))
    return points.join(found, "id", "left").select(*points.columns, F.col("found.wts").alias("wts"), F.col("found.value").alias("value"))
