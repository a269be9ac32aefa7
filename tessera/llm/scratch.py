"""Rows in pieces, names, and the winners of groups; ``Scratch`` holds the tables of one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import Shared as Scratch

__all__ = ["Scratch", "keep_winners", "row_mark", "slices", "unused", "winners"]


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of so many rows, so that only a piece's texts are Python objects at a time."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_mark(text: str):
    """64 bits that, with the document's id, name a row."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def winners(members: DataFrame, group: list[str], id_col: str, mark: str) -> DataFrame:
    """Of each group the row with the smallest id (nulls last), with how many rows repeat it.

    ``members`` holds a row per document with the group's columns, the id and ``row_mark``.  Both
    steps aggregate before they shuffle, so a group of any size is a few rows per task.
    """
    rows = members.groupBy(*group, id_col, mark).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(mark).alias("mark"), F.col("n").alias("same"))
    best = rows.groupBy(*group).agg(F.min(order).alias("best"), F.sum("n").alias("size"))
    return best.select(*group, F.col("best.id").alias("win_id"), F.col("best.mark").alias("win_mark"), F.col("best.same").alias("win_same"), "size")


def keep_winners(docs: DataFrame, best: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``best`` (see ``winners``; a written table) names, one of each.

    The join key holds the document's id, so a large group is no large key.  Rows that repeat a
    winner exactly are merged by an aggregation that combines before it shuffles.
    """
    mark, m_id, m_mark, same = unused(docs, "row_mark", "m_id", "m_mark", "m_same")
    right = best.select(F.col("win_id").alias(m_id), F.col("win_mark").alias(m_mark), F.col("win_same").alias(same))
    left = docs.withColumn(mark, row_mark(text))
    kept = left.join(right.hint("merge"), left[id_col].eqNullSafe(right[m_id]) & (left[mark] == right[m_mark]))
    if best.where("win_same > 1").isEmpty():
        return kept.select(*docs.columns)
    once = kept.where(F.col(same) == 1).select(*docs.columns)
    many = kept.where(F.col(same) > 1).dropDuplicates([id_col, mark]).select(*docs.columns)
    return once.unionByName(many)
