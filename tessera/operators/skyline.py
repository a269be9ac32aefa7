"""Skylines: rows that no other row dominates (smaller is better in every column)."""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import Shared

#: Price ranges that the sort form cuts the distinct prices into.
RANGES = 256
#: Distinct tuples up to which the definition is joined as it stands.
NESTED = 100_000
#: Rows of a block of the local pass, comparisons made at once, and partitions merged into one.
BLOCK, CELLS, MERGE = 1_000, 1 << 22, 8


def dominates(a: list[Column], b: list[Column]) -> Column:
    """Whether ``a`` is nowhere larger than ``b`` and somewhere smaller."""
    no_worse = reduce(operator.and_, (x <= y for x, y in zip(a, b, strict=True)))
    return no_worse & reduce(operator.or_, (x < y for x, y in zip(a, b, strict=True)))


def incomparable(a: list[Column], b: list[Column]) -> Column:
    return ~dominates(a, b) & ~dominates(b, a)


def skyline_nested(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The definition, as a theta anti-join against the distinct tuples: quadratic, for small inputs.

    Beyond ``NESTED`` distinct tuples, which are broadcast, the local skylines are merged instead.
    Null tuples are comparable to none and stay.
    """
    other = rows.select(*(F.col(c).alias(f"_o_{c}") for c in columns)).distinct()
    if other.limit(NESTED + 1).count() > NESTED:
        null = reduce(operator.or_, (F.col(c).isNull() for c in columns))
        return skyline_local_global(rows, columns).unionByName(rows.where(null))
    return rows.join(F.broadcast(other), dominates([F.col(f"_o_{c}") for c in columns], [F.col(c) for c in columns]), "left_anti")


def skyline_sorted(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Two columns: a tuple stays if its y is below that of every smaller x, and least for its x.

    Least y for each x first (combined before the shuffle).  The distinct x are cut into ranges at
    approximate quantiles; each range starts from the least y of the ranges before it, so no task
    sees more than a range.  Equal tuples are incomparable and all stay; null tuples are left out.
    """
    usable = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    least = usable.groupBy(F.col(x).alias("x")).agg(F.min(y).alias("y"))
    cuts = least.agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 10_000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    ranged = least.withColumn("range", _range_of(F.col("x"), cuts))
    by_range = ranged.groupBy("range").agg(F.min("y").alias("low"))  # a row for each range
    before = by_range.select("range", F.min("low").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("low"))
    inner = F.min("y").over(Window.partitionBy("range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    best = ranged.join(F.broadcast(before), "range").withColumn("below", F.least("low", inner))
    kept = best.where(F.col("below").isNull() | (F.col("y") < F.col("below"))).select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    return rows.join(kept, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left_semi")


def _range_of(x: Column, cuts: list, first: int = 0) -> Column:
    """How many of the sorted cuts are below x, by binary search."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(x > F.lit(cuts[mid]), _range_of(x, cuts[mid + 1 :], first + mid + 1)).otherwise(_range_of(x, cuts[:mid], first))


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Each column's dense ranks: exact for integers of any size, and in Spark's order, NaN last."""
    return np.column_stack([np.unique(c, return_inverse=True)[1] for c in columns])


def _beaten(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows some row of ``by`` dominates."""
    out = np.zeros(len(rows), bool)
    step = max(1, CELLS // max(1, by.size))
    for i in range(0, len(rows), step):
        some = rows[i : i + step, None, :]
        out[i : i + step] = ((by <= some).all(2) & (by < some).any(2)).any(1)
    return out


def _undominated(rows: np.ndarray) -> np.ndarray:
    """Positions of the rows that no other dominates, equal ones kept, in order."""
    rest, kept = np.lexsort(rows.T[::-1]), []
    while len(rest):  # the lexicographically first row of those left is dominated by none
        left, first = rows[rest], rows[rest[0]]
        kept.append(rest[(left == first).all(1)])
        rest = rest[~(first <= left).all(1)]
    return np.sort(np.concatenate([*kept, np.zeros(0, int)]))


def skyline_local_global(rows: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Any number of columns: each partition keeps a running skyline of its blocks, and partitions'
    skylines are merged ``MERGE`` at a time, in rounds, until one is left.

    Each round is a written table, so no survivor is found twice.  Columns may be of any type that
    Spark orders; equal tuples all stay, null tuples are left out.
    """
    usable = rows.where(reduce(operator.and_, (F.col(c).isNotNull() for c in columns)))
    places = [rows.columns.index(c) for c in columns]

    def run(batches):
        held = None
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = pa.Table.from_batches([b.slice(a, block)])
                n = 0 if held is None else held.num_rows
                both = part if held is None else pa.concat_tables([held, part])
                values = _ranks([both.column(p).to_numpy() for p in places])
                old, new = values[:n], np.arange(n, len(values))
                new = new[~_beaten(values[new], old)]
                new = new[_undominated(values[new])]
                stay = np.flatnonzero(~_beaten(old, values[new]))
                held = both.take(pa.array(np.concatenate([stay, new])))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    shared = Shared(rows.sparkSession, "skyline")
    found = shared.save(usable.mapInArrow(run, rows.schema), "local")
    parts, k = max(2, found.rdd.getNumPartitions()), 0
    while parts > 1:
        parts, k = -(-parts // MERGE), k + 1
        found = shared.save(found.repartition(parts).mapInArrow(run, rows.schema), f"round-{k}")
    return found
