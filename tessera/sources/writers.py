"""Sinks: one line of answers, ordered and unordered delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_line(answers: DataFrame, order: str, value: str) -> DataFrame:
    """One row ``line``: the values in order, comma-joined; no answers give one empty line.

    The line is the result of a query file, so its size is that file's.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return answers.agg(F.array_join(F.transform(pairs, lambda p: p["v"]), ",").alias("line"))


def write_answer_line(answers: DataFrame, order: str, value: str, path: str) -> None:
    answer_line(answers, order, value).coalesce(1).write.mode("overwrite").text(path)


def _lines(rows: DataFrame, sep: str) -> DataFrame:
    """Each row as one line; nulls are empty, nothing is quoted."""
    return rows.select(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)).alias("line"))


def write_ordered(rows: DataFrame, order: list[str], path: str, drop: list[str] | None = None, single: bool = False, sep: str = ",") -> None:
    """Write rows in order; part files sort by name.  ``single`` makes one file, for small results."""
    out = (rows.coalesce(1) if single else rows).orderBy(*order)
    out = _lines(out.drop(*(drop or [])), sep)
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def write_unordered(rows: DataFrame, path: str, single: bool = False, sep: str = ",") -> None:
    out = _lines(rows, sep)
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)
