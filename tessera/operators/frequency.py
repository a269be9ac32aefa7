"""How often a key occurred: in the last w events, or so far; exactly, or from jumping blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import count_terms

#: Events of a block when counts are taken exactly.
EXACT_BLOCK = 4_096


def block_size(window: int, error: float) -> int:
    """floor(2 error window), the jumping window's block; raises if that is zero."""
    size = int(2 * error * window)
    if window <= 0 or size <= 0:
        raise ValueError(f"a window of {window} with error {error} has no block")
    return size


def block_counts(events: DataFrame, size: int) -> DataFrame:
    """``(blk, key, n)``."""
    return events.groupBy(F.expr(f"seq div {size}").alias("blk"), "key").agg(F.count(F.lit(1)).alias("n"))


def window_running(events: DataFrame, window: int) -> DataFrame:
    """Every event with the count of its key among the last ``window`` events, itself included.

    Events are cut into stretches of ``window`` numbers and each also goes to the stretch after its
    own, where it precedes others: a frame then lies within one stretch, and no window partition
    holds more than 2 ``window`` events, however hot its key.
    """
    own = F.expr(f"seq div {window}")
    spread = events.select("seq", "key", own.alias("own"), F.explode(F.array(own, own + 1)).alias("stretch"))
    order = Window.partitionBy("key", "stretch").orderBy("seq").rangeBetween(-(window - 1), 0)
    return spread.withColumn("n", F.count(F.lit(1)).over(order)).where("own = stretch").select("seq", "key", "n")


def window_exact(events: DataFrame, queries: DataFrame, block: int = EXACT_BLOCK) -> DataFrame:
    """``queries(t, key, w)`` with ``n``: events of the key with t - w < seq <= t.

    The difference of two counts from the start, so that a hot key's events never meet in a task.
    """
    ends = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("t").alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col("t") - F.col("w")).alias("at")))).alias("end")
    points = queries.distinct().select("t", "key", "w", ends)
    points = points.select(F.struct("t", "key", "w", "end.sign").alias("id"), "key", F.col("end.at").alias("seq"))
    terms = count_terms(events, points, block).groupBy("id.t", "id.key", "id.w")
    return queries.join(terms.agg(F.sum(F.col("id.sign") * F.col("x")).alias("n")), ["t", "key", "w"])


def point_frequency(events: DataFrame, queries: DataFrame, block: int = EXACT_BLOCK) -> DataFrame:
    """``queries(t, key)`` with ``n``: events of the key up to and with t."""
    points = queries.distinct().select(F.struct("t", "key").alias("id"), "key", F.col("t").alias("seq"))
    found = count_terms(events, points, block).groupBy("id.t", "id.key").agg(F.sum("x").alias("n"))
    return queries.join(found, ["key", "t"])


def jumping_window(events: DataFrame, queries: DataFrame, window: int, error: float) -> DataFrame:
    """``queries(t, key, w)`` (w = 0: the whole window) with ``est``, within half a block of exact.

    Whole blocks count in full, the block the window's edge falls in counts half, and the current
    block is counted exactly; a window inside the current block is too.  A query meets window/size
    + 2 blocks at most, by equi-join on (key, block).  Windows beyond ``window`` raise.
    """
    size = block_size(window, error)
    wide = F.when(F.col("w") == 0, F.lit(window)).otherwise(F.col("w"))
    bad = (wide > window) | (wide < 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("window out of range: "), F.col("w").cast("string"))).cast("bigint")).otherwise(wide)
    q = queries.distinct().select("t", "key", "w", checked.cast("bigint").alias("wide"))
    q = q.select("*", F.expr(f"t div {size}").alias("j"), F.expr(f"wide - (t % {size} + 1)").alias("f"))
    q = q.select("*", F.expr(f"CASE WHEN f > 0 THEN f div {size} ELSE 0 END").alias("q"), F.expr(f"CASE WHEN f > 0 THEN f % {size} ELSE 0 END").alias("r"))
    blocks = block_counts(events, size)
    past = q.where("f > 0 AND j > 0").withColumn("blk", F.explode(F.expr("sequence(greatest(0L, j - q - 1), j - 1)")))
    past = past.where("blk >= j - q OR r > 0").join(blocks, ["key", "blk"])
    past = past.groupBy("t", "key", "w").agg(F.sum(F.expr("CASE WHEN blk >= j - q THEN n ELSE n div 2 END")).alias("past"))
    marked = events.select("key", "seq", F.expr(f"seq div {size}").alias("j"))
    now = q.join(marked, ["key", "j"]).where("seq <= t AND seq > t - wide").groupBy("t", "key", "w").agg(F.count(F.lit(1)).alias("now"))
    est = q.select("t", "key", "w").join(past, ["t", "key", "w"], "left").join(now, ["t", "key", "w"], "left")
    est = est.select("t", "key", "w", (F.coalesce("past", F.lit(0)) + F.coalesce("now", F.lit(0))).alias("est"))
    return queries.join(est, ["t", "key", "w"])
