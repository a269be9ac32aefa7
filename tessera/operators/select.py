"""Column selection: typed conjunctive predicates, projection lists, row ids, dictionaries."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE = {"=": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def parse_where(text: str) -> list[tuple[str, str, str]]:
    """``attr|op|value,attr|op|value`` to clauses; an empty text has none.  Values keep their spaces."""
    out = []
    for clause in text.split(",") if text.strip() else []:
        parts = clause.split("|")
        if len(parts) != 3 or parts[1] not in COMPARE:
            raise ValueError(f"not a clause: {clause!r}")
        out.append((parts[0].strip(), parts[1], parts[2]))
    return out


def predicate(frame: DataFrame, clauses: list[tuple[str, str, str]]) -> Column:
    """The conjunction; literals take the column's type, floats are compared as 32 bits."""
    found = []
    for name, op, value in clauses:
        if name not in frame.columns:
            raise ValueError(f"no such column: {name}")
        kind = frame.schema[name].dataType
        if isinstance(kind, T.FloatType):
            literal = F.lit(float(value)).cast("float")
        elif isinstance(kind, T.FractionalType):
            literal = F.lit(float(value))
        elif isinstance(kind, T.IntegralType):
            literal = F.lit(int(value))
        else:
            literal = F.lit(value)
        found.append(COMPARE[op](F.col(name), literal))
    return reduce(operator.and_, found, F.lit(True))


def select_where(frame: DataFrame, columns: list[str], where: str = "") -> DataFrame:
    """Projection list (order kept, repeats allowed) of the rows that satisfy all clauses.

    One scan: the predicate reaches the file and only named columns are read.
    """
    missing = [c for c in columns if c not in frame.columns]
    if missing or not columns:
        raise ValueError(f"no such columns: {missing}")
    return frame.where(predicate(frame, parse_where(where))).select(*columns)


def ids_where(frame: DataFrame, key: list[str], where: str) -> DataFrame:
    """Keys of the rows that satisfy all clauses, by intersecting each clause's keys."""
    clauses = parse_where(where) or [None]
    parts = [frame.where(predicate(frame, [c]) if c else F.lit(True)).select(*key) for c in clauses]
    return reduce(lambda a, b: a.intersect(b), parts)


def fetch(frame: DataFrame, ids: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Late materialisation: the columns of the rows whose key is among ``ids``."""
    return frame.join(ids, key, "left_semi").select(*columns)


def dictionary(frame: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: distinct values with dense codes from 0 in value order; null has none.

    The ranking window sees distinct values only; a dictionary column has few.
    """
    values = frame.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("bigint").alias("code"))


def encode(frame: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``frame`` with ``<column>_code`` instead of the column."""
    named = codes.select(F.col("value").alias("_value"), F.col("code").alias(f"{column}_code"))
    return frame.join(named, frame[column] == F.col("_value"), "left").drop(column, "_value")


def decode(frame: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    named = codes.select(F.col("code").alias("_code"), F.col("value").alias(column))
    return frame.join(named, frame[f"{column}_code"] == F.col("_code"), "left").drop(f"{column}_code", "_code")


def encoded_where(frame: DataFrame, column: str, codes: DataFrame, op: str, value: str) -> DataFrame:
    """Rows of an encoded frame whose code's value satisfies the comparison; any operator, and a
    literal the dictionary lacks is compared like any other."""
    chosen = codes.where(COMPARE[op](F.col("value"), F.lit(value))).select(F.col("code").alias(f"{column}_code"))
    return frame.join(chosen, f"{column}_code", "left_semi")
