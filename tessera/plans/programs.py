"""The engine over files: each program reads its inputs, answers and writes the answers.

    python -m tessera.plans.programs select IN OUT SCHEMA PROJECTION WHERE [--dictionary COLUMN]
    python -m tessera.plans.programs join CUSTOMER ORDERS OUT
    python -m tessera.plans.programs windows EVENTS QUERIES OUT [--window W] [--error E]
    python -m tessera.plans.programs points EVENTS QUERIES OUT [--sketch]
    python -m tessera.plans.programs ranges EVENTS QUERIES OUT
    python -m tessera.plans.programs skyline IN OUT [--block N]
    python -m tessera.plans.programs bloom R S OUT [--buckets N]
    python -m tessera.plans.programs schedule LOG OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.net import first_octet, ipv4_to_long
from tessera.operators import frequency, joins, mvto, ranges, select, sketches, skyline
from tessera.sources import readers, writers


def column_store(spark: SparkSession, source: str, out: str, schema: str, projection: str, where: str = "", dictionary: str | None = None) -> DataFrame:
    """``SELECT projection WHERE where`` of a delimited file, in file order.

    The part files are in order by name; each is a range of rows.  With ``dictionary`` the clauses
    on that (string) column are answered on its codes.
    """
    rows = readers.with_sequence(readers.delimited(spark, source, schema), "_row")
    columns = [c.strip() for c in projection.split(",")]
    if dictionary is None:
        found = select.select_where(rows, [*columns, "_row"], where)
    else:
        clauses = select.parse_where(where)
        plain = [c for c in clauses if c[0] != dictionary]
        codes = select.dictionary(rows, dictionary)
        coded = select.encode(rows.where(select.predicate(rows, plain)), dictionary, codes)
        for name, op, value in clauses:
            if name == dictionary:
                coded = select.encoded_where(coded, dictionary, codes, op, value)
        found = select.decode(coded, dictionary, codes).select(*columns, "_row")
    writers.write_ordered(found, ["_row"], out, drop=["_row"])
    return found.drop("_row")


def hash_join(spark: SparkSession, customer: str, orders: str, out: str) -> DataFrame:
    """Custkey and comment of the orders (columns 1 and 8) whose customer (column 0) is there."""
    part = F.split("value", r"\|")
    c = spark.read.text(customer).select(part[0].alias("c_custkey"))
    o = spark.read.text(orders).select(part[1].alias("o_custkey"), part[8].alias("o_comment"))
    found = joins.semi_join(o, c, "o_custkey", "c_custkey")
    writers.write_unordered(found, out, single=True)
    return found


def window_answers(spark: SparkSession, events: str, queries: str, out: str, window: int = 10_000, error: float = 0.01) -> DataFrame:
    """Jumping-window estimates for /8 prefixes, one comma-joined line in query order."""
    e = readers.events(spark, events).select("seq", first_octet(F.col("ip")).alias("key"))
    q = readers.point_queries(spark, queries).select(F.col("time").alias("t"), first_octet(F.col("ip")).alias("key"), F.col("window").alias("w"))
    found = frequency.jumping_window(e, q, window, error)
    writers.write_answer_line(found, "t", "est", out)
    return found


def point_answers(spark: SparkSession, events: str, queries: str, out: str, sketch: bool = False, error: float = 0.01, confidence: float = 0.9, keys: int = 400_000, p: float = 0.1) -> DataFrame:
    """How often each address was seen up to the query's time; from sketches if asked for."""
    e = readers.events(spark, events).select("seq", ipv4_to_long(F.col("ip")).alias("key"))
    q = readers.point_queries(spark, queries).select(F.col("time").alias("t"), ipv4_to_long(F.col("ip")).alias("key"))
    if sketch:
        size = sketches.plan(error, confidence, keys, p)
        found = sketches.estimate_at(e, q, size["depth"], size["width"], size["bits"], size["hashes"]).withColumnRenamed("est", "n")
    else:
        found = frequency.point_frequency(e, q)
    writers.write_answer_line(found, "t", "n", out)
    return found


def range_answers(spark: SparkSession, events: str, queries: str, out: str) -> DataFrame:
    """Whether any address of each inclusive range was seen."""
    e = readers.events(spark, events).select(ipv4_to_long(F.col("ip")).alias("key"))
    q = readers.range_queries(spark, queries)
    found = ranges.exists_in_range(q.select("id", ipv4_to_long(F.col("ip_lo")).alias("l"), ipv4_to_long(F.col("ip_hi")).alias("r")), e, "key")
    writers.write_answer_line(found, "id", "found", out)
    return found


def skyline_file(spark: SparkSession, source: str, out: str, block: int = skyline.BLOCK) -> DataFrame:
    """The undominated (price, age) tuples of a ``price|age`` file."""
    found = skyline.skyline_local_global(readers.tuples(spark, source), ["price", "age"], block)
    writers.write_ordered(found, ["price", "age"], out, single=True, sep="|")
    return found


def bloom_join_files(spark: SparkSession, r: str, s: str, out: str, buckets: int = 10_000) -> DataFrame:
    """The natural join of ``a|b`` and ``b|c`` files in ``OUT/rows``, the bytes each side sent in ``OUT/bytes``."""
    left, right = readers.delimited(spark, r, "a BIGINT, b BIGINT", sep="|"), readers.delimited(spark, s, "b BIGINT, c BIGINT", sep="|")
    found = joins.bloom_join(left, right, "b", buckets).select("a", "b", "c")
    writers.write_unordered(found, f"{out}/rows", sep="|")
    sent = joins.reduction_stats(left, right, "b", buckets).select("bytes_from_r", "bytes_from_s")
    writers.write_unordered(sent, f"{out}/bytes", single=True)
    return found


def run_schedule(spark: SparkSession, log: str, out: str) -> DataFrame:
    """Replay ``shard,seq,xact,op,key,value`` lines; one line an operation, by shard and step."""
    found = mvto.replay(readers.delimited(spark, log, "shard BIGINT, seq BIGINT, xact BIGINT, op STRING, key BIGINT, value BIGINT"))
    writers.write_ordered(found, ["shard", "seq"], out)
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = parser.add_subparsers(dest="program", required=True)
    shapes = {"select": (column_store, ["source", "out", "schema", "projection", "where"]), "join": (hash_join, ["customer", "orders", "out"]), "windows": (window_answers, ["events", "queries", "out"]), "points": (point_answers, ["events", "queries", "out"]), "ranges": (range_answers, ["events", "queries", "out"]), "skyline": (skyline_file, ["source", "out"]), "bloom": (bloom_join_files, ["r", "s", "out"]), "schedule": (run_schedule, ["log", "out"])}
    options = {"select": {"dictionary": str}, "windows": {"window": int, "error": float}, "skyline": {"block": int}, "bloom": {"buckets": int}}
    for name, (_, places) in shapes.items():
        one = kinds.add_parser(name)
        for place in places:
            one.add_argument(place)
        for option, kind in options.get(name, {}).items():
            one.add_argument(f"--{option}", type=kind, default=argparse.SUPPRESS)
        if name == "points":
            one.add_argument("--sketch", action="store_true")
    given = vars(parser.parse_args(args))
    program = shapes[given.pop("program")][0]
    program(SparkSession.builder.getOrCreate(), **given)


if __name__ == "__main__":
    main()
