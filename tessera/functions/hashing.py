"""Fixed-seed linear hashes, the same in Spark, in Python and in any SQL with 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2**31 - 1


def seeds(count: int, start: int = 12345) -> list[tuple[int, int]]:
    """``count`` pairs (a, b), 0 < a < PRIME and 0 <= b < PRIME, by a linear congruential sequence."""
    out, x = [], start
    for _ in range(count):
        pair = []
        for _ in range(2):
            x = (6364136223846793005 * x + 1442695040888963407) % 2**64
            pair.append((x >> 33) % PRIME)
        out.append((max(1, pair[0]), pair[1]))
    return out


def linear(x: Column, a: int | Column, b: int | Column, cells: int | Column) -> Column:
    """((a x + b) mod PRIME) mod cells.  The key is reduced first, so products stay below 2^62."""
    a, b, cells = (v if isinstance(v, Column) else F.lit(v) for v in (a, b, cells))
    return F.pmod(F.pmod(a * F.pmod(x.cast("bigint"), F.lit(PRIME)) + b, F.lit(PRIME)), cells)


def linear_sql(x: str, a: int, b: int, cells: int) -> str:
    """The same for a key from 0 on, as SQL text."""
    return f"((({a} * ({x} % {PRIME}) + {b}) % {PRIME}) % {cells})"
