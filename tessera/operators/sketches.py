"""Count-min sketches and Bloom filters as relations, with fixed seeds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import linear, seeds
from tessera.operators.joins import counts_up_to

LIMIT_BYTES = 10_000_000
#: Words of filters up to which they are broadcast, 16 bytes each.
BROADCAST_WORDS = 1_000_000


def count_min_size(error: float, confidence: float) -> tuple[int, int]:
    """Depth ceil(ln 1/(1 - confidence)) and width ceil(e/error)."""
    return math.ceil(math.log(1 / (1 - confidence))), math.ceil(math.e / error)


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for n keys at false-positive chance p."""
    if n <= 0 or not 0 < p < 1:
        raise ValueError(f"no filter for {n} keys at {p}")
    bits = math.ceil(-math.log(p) * n / math.log(2) ** 2)
    return bits, math.ceil(math.log(2) * bits / n)


def plan(error: float, confidence: float, n: int, p: float, limit: int = LIMIT_BYTES) -> dict[str, int]:
    """Sizes of a count-min sketch with a Bloom filter in front; raises beyond ``limit`` bytes."""
    depth, width = count_min_size(error, confidence)
    bits, hashes = bloom_size(n, p)
    used = 4 * depth * width + math.ceil(bits / 8) + 16 * (depth + hashes)
    if used > limit:
        raise ValueError(f"the sketch takes {used} of {limit} bytes")
    return {"depth": depth, "width": width, "bits": bits, "hashes": hashes, "bytes": used}


def _hashed(keys: DataFrame, key: str, count: int, cells: int, start: int, name: str) -> DataFrame:
    """``keys`` with a row for each hash: its number and its cell."""
    each = [F.struct(F.lit(i).alias("row"), linear(F.col(key), a, b, cells).alias(name)) for i, (a, b) in enumerate(seeds(count, start))]
    return keys.withColumn("_h", F.explode(F.array(*each))).select(*keys.columns, F.col("_h.row").alias("row"), F.col(f"_h.{name}").alias(name))


def count_min(events: DataFrame, key: str, depth: int, width: int, start: int = 12345) -> DataFrame:
    """``(row, cell, n)``: depth x width counters at most.  Keys are counted before they are hashed."""
    sums = events.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return _hashed(sums, "key", depth, width, start, "cell").groupBy("row", "cell").agg(F.sum("n").alias("n"))


def count_min_estimate(sketch: DataFrame, queries: DataFrame, key: str, depth: int, width: int, start: int = 12345) -> DataFrame:
    """``queries`` with ``est``, never below the true count.  The sketch is broadcast: its size is fixed."""
    cells = _hashed(queries.select(F.col(key).alias("key")).distinct(), "key", depth, width, start, "cell")
    found = cells.join(F.broadcast(sketch), ["row", "cell"], "left").groupBy(F.col("key").alias("_key")).agg(F.min(F.coalesce("n", F.lit(0))).alias("est"))
    return queries.join(found, F.col(key) == F.col("_key")).drop("_key")


def packed(positions: DataFrame, *by: str) -> DataFrame:
    """``(*by, word, bits)``: the set bits of filters, 64 to a word, from ``(*by, pos)``."""
    return positions.groupBy(*by, F.expr("pos div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(pos % 64)))").alias("bits"))


def probed(probes: DataFrame, words: DataFrame, size: int, *by: str) -> DataFrame:
    """``probes`` with ``held``, 1 where the bit at ``pos`` is set.

    A filter of ``size`` bits has size / 64 words; up to ``BROADCAST_WORDS`` they are broadcast.
    """
    words = F.broadcast(words) if size <= 64 * BROADCAST_WORDS else words
    joined = probes.withColumn("word", F.expr("pos div 64")).join(words, [*by, "word"], "left")
    return joined.select(*probes.columns, F.expr("CASE WHEN shiftright(bits, int(pos % 64)) & 1 = 1 THEN 1 END").alias("held"))


def bloom(keys: DataFrame, key: str, bits: int, hashes: int, start: int = 54321) -> DataFrame:
    """``(word, bits)``: the filter's words, at most ``bits`` / 64."""
    distinct = keys.select(F.col(key).alias("key")).distinct()
    return packed(_hashed(distinct, "key", hashes, bits, start, "pos").select("pos"))


def bloom_contains(filter_bits: DataFrame, queries: DataFrame, key: str, bits: int, hashes: int, start: int = 54321) -> DataFrame:
    """``queries`` with ``member``: true for every key in the filter and for few others."""
    probes = _hashed(queries.select(F.col(key).alias("key")).distinct(), "key", hashes, bits, start, "pos")
    found = probed(probes, filter_bits, bits).groupBy(F.col("key").alias("_key")).agg((F.count("held") == F.count(F.lit(1))).alias("member"))
    return queries.join(found, F.col(key) == F.col("_key")).drop("_key")


def guarded_estimate(sketch: DataFrame, filter_bits: DataFrame, queries: DataFrame, key: str, depth: int, width: int, bits: int, hashes: int) -> DataFrame:
    """Count-min estimates, 0 for keys the Bloom filter rules out."""
    member = bloom_contains(filter_bits, queries, key, bits, hashes)
    est = count_min_estimate(sketch, member, key, depth, width)
    return est.select(*queries.columns, F.when(F.col("member"), F.col("est")).otherwise(F.lit(0).cast("bigint")).alias("est"))


def estimate_at(events: DataFrame, queries: DataFrame, depth: int, width: int, bits: int, hashes: int, block: int = 4_096) -> DataFrame:
    """``queries(t, key)`` with ``est``: the guarded estimate of sketches that hold the events up to t.

    ``events(seq, key)``.  A counter's value at t is how often its (row, cell) was hit up to t, and
    a bit is set at t if its first hit is no later.
    """
    asked = queries.select("t", "key").distinct()
    cell = (F.col("row") * width + F.col("cell")).alias("key")
    hits = _hashed(events.select("seq", "key"), "key", depth, width, 12345, "cell").select("seq", cell)
    probes = _hashed(asked, "key", depth, width, 12345, "cell").select("t", F.col("key").alias("asked"), cell)
    points = probes.select("key", F.col("t").alias("seq")).distinct().withColumn("id", F.struct("key", "seq"))
    counted = counts_up_to(hits, points, block).select("id.key", F.col("id.seq").alias("t"), "n")
    est = probes.join(counted, ["key", "t"]).groupBy("t", F.col("asked").alias("key")).agg(F.min("n").alias("low"))
    since = _hashed(events.groupBy("key").agg(F.min("seq").alias("seq")), "key", hashes, bits, 54321, "pos").groupBy("pos").agg(F.min("seq").alias("since"))
    bit = _hashed(asked, "key", hashes, bits, 54321, "pos").join(since, "pos", "left")
    member = bit.groupBy("t", "key").agg((F.count(F.when(F.col("since") <= F.col("t"), 1)) == F.count(F.lit(1))).alias("member"))
    found = est.join(member, ["t", "key"]).select("t", "key", F.when(F.col("member"), F.col("low")).otherwise(F.lit(0).cast("bigint")).alias("est"))
    return queries.join(found, ["t", "key"])
