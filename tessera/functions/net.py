"""IPv4 addresses as unsigned 32-bit numbers in BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _octet(ip: Column, i: int) -> Column:
    return F.split_part(ip, F.lit("."), F.lit(i)).cast("bigint")


def first_octet(ip: Column) -> Column:
    """The /8 prefix of a dotted address, 0 to 255."""
    return _octet(ip, 1).cast("int")


def ipv4_to_long(ip: Column) -> Column:
    """A dotted address as a number from 0 to 2^32 - 1; malformed octets raise, as any ANSI cast does."""
    return F.shiftleft(_octet(ip, 1), 24) + F.shiftleft(_octet(ip, 2), 16) + F.shiftleft(_octet(ip, 3), 8) + _octet(ip, 4)


def long_to_ipv4(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))
