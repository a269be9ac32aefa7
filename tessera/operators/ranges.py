"""Range existence over 32-bit keys by dyadic intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import linear, seeds
from tessera.operators.sketches import bloom_size, packed, probed

HEIGHTS = 32


def cover(queries: DataFrame) -> DataFrame:
    """``queries(id, l, r)`` to ``(id, h, node)``: the disjoint dyadic intervals that make up [l, r].

    Interval (h, node) holds the keys with key >> h = node.  At most two for each height; an empty
    range has none.  One row becomes 33 candidates at most, whatever the range.
    """
    heights = queries.select("id", "l", "r", F.explode(F.sequence(F.lit(0), F.lit(HEIGHTS))).alias("h"))
    ends = heights.select("id", "h", F.expr("shiftright(l + shiftleft(1L, h) - 1, h)").alias("lo"), F.expr("shiftright(r + 1, h)").alias("hi"))
    pick = F.array_compact(F.array(F.when(F.col("lo") % 2 == 1, F.col("lo")), F.when(F.col("hi") % 2 == 1, F.col("hi") - 1)))
    return ends.where("lo < hi").select("id", "h", F.explode(pick).alias("node"))


def contained(inner_l, inner_r, outer_l, outer_r):
    """Whether one interval lies within the other."""
    return (inner_l >= outer_l) & (inner_r <= outer_r)


def prefixes(keys: DataFrame, key: str) -> DataFrame:
    """``(h, node)``: the dyadic intervals with a key.  Keys are made distinct before they are spread."""
    distinct = keys.select(F.col(key).alias("key")).distinct()
    spread = distinct.select("key", F.explode(F.sequence(F.lit(0), F.lit(HEIGHTS))).alias("h"))
    return spread.select("h", F.expr("shiftright(key, h)").alias("node")).distinct()


def exists_in_range(queries: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``queries`` with ``found``: whether a key lies in [l, r]; exact, by equi-join on (h, node)."""
    hits = cover(queries.select("id", "l", "r")).join(prefixes(keys, key), ["h", "node"], "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    return queries.join(hits, "id", "left").select(*queries.columns, F.coalesce("hit", F.lit(False)).alias("found"))


def level_sizes(n: int, p: float) -> list[tuple[int, int]]:
    """Bits and hashes of each height's filter: n keys at most, 2^(32 - h) nodes at most; a whole
    cover (64 probes) is wrong with chance p."""
    each = 1 - (1 - p) ** (1 / 64)
    return [bloom_size(max(1, min(2 ** (HEIGHTS - h), n)), each) for h in range(HEIGHTS + 1)]


def _positions(nodes: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """``nodes`` with a row for each hash of their height's filter, by a table of all parameters
    (a row for each height and hash)."""
    pairs = seeds(max(k for _, k in sizes), 777)
    rows = [(h, i, a, b, bits) for h, (bits, hashes) in enumerate(sizes) for i, (a, b) in enumerate(pairs[:hashes])]
    table = nodes.sparkSession.createDataFrame(rows, "p_h int, row int, a long, b long, bits long")
    joined = nodes.join(F.broadcast(table), F.col("h") == F.col("p_h"))
    return joined.select(*nodes.columns, "row", linear(F.col("node"), F.col("a"), F.col("b"), F.col("bits")).alias("pos"))


def range_filters(keys: DataFrame, key: str, sizes: list[tuple[int, int]]) -> DataFrame:
    """``(h, word, bits)``: one Bloom filter for each height, 64 bits to a word."""
    return packed(_positions(prefixes(keys, key), sizes).select("h", "pos"), "h")


def range_bloom(queries: DataFrame, filters: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """``queries`` with ``found``: true wherever a key lies in [l, r], and seldom elsewhere."""
    probes = _positions(cover(queries.select("id", "l", "r")), sizes)
    nodes = probed(probes, filters, sum(bits for bits, _ in sizes), "h").groupBy("id", "h", "node").agg((F.count("held") == F.count(F.lit(1))).alias("all"))
    hits = nodes.groupBy("id").agg(F.bool_or("all").alias("hit"))
    return queries.join(hits, "id", "left").select(*queries.columns, F.coalesce("hit", F.lit(False)).alias("found"))
