"""The registered queries over the test tables, and the SQL that gives the same rows.

``events`` stands for the stream: ``event_id`` is the arrival index, ``user_id`` the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import linear_sql, seeds
from tessera.functions.net import first_octet, ipv4_to_long, long_to_ipv4
from tessera.operators import frequency, joins, mvto, ranges, select, sketches, skyline
from tessera.sources.readers import inline_relations, table, with_sequence
from tessera.sources.shared import Shared
from tessera.sources.writers import answer_line
from tessera.streaming import frequency as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


# -- column selection ---------------------------------------------------------------------------

@register("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R' AND l_linenumber <= 3")
def colstore_select(spark, sf):
    return select.select_where(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], "l_quantity|>|30,l_returnflag|=|R,l_linenumber|<=|3")


@register("SELECT p_partkey, p_name FROM part WHERE p_size >= 10 AND p_size < 20 AND CAST(p_retailprice AS REAL) > CAST(950.25 AS REAL)")
def colstore_typed_comparisons(spark, sf):
    part = table(spark, sf, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("float"))
    return select.select_where(part, ["p_partkey", "p_name"], "p_size|>=|10,p_size|<|20,p_retailprice|>|950.25")


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 INTERSECT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def colstore_ids_intersect(spark, sf):
    return select.ids_where(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity|>|30,l_returnflag|=|R")


@register("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def colstore_late_materialization(spark, sf):
    orders = table(spark, sf, "orders")
    ids = select.ids_where(orders, ["o_orderkey"], "o_totalprice|>|200000,o_orderstatus|=|F")
    return select.fetch(orders, ids, ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderpriority"])


@register("SELECT l_returnflag AS value, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL)")
def dict_encode(spark, sf):
    return select.dictionary(table(spark, sf, "lineitem"), "l_returnflag")


@register("""WITH d AS (SELECT p_brand AS value, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_brand FROM part))
SELECT p_partkey, code AS p_brand_code FROM part JOIN d ON p_brand = value WHERE p_brand >= 'Brand#3'""")
def dict_filter(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    codes = select.dictionary(part, "p_brand")
    return select.encoded_where(select.encode(part, "p_brand", codes), "p_brand", codes, ">=", "Brand#3")


@register("SELECT p_partkey, p_brand FROM part")
def dict_round_trip(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    codes = select.dictionary(part, "p_brand")
    return select.decode(select.encode(part, "p_brand", codes), "p_brand", codes)


_FILE = "CASE WHEN event_id % 100 = 0 THEN 'a' WHEN event_id % 10 = 3 THEN 'b' ELSE 'c' END"


@register(f"SELECT event_id, CAST(row_number() OVER (ORDER BY {_FILE}, event_id) - 1 AS BIGINT) AS seq FROM events")
def folder_sequence(spark, sf):
    """Lines numbered through a folder of files, the smallest of which comes first."""
    folder = f"{Shared(spark, 'folder').path}/events"
    lines = table(spark, sf, "events").select("event_id", F.concat_ws("\t", "event_id", "event_type").alias("value"), F.expr(_FILE).alias("file"))
    lines.repartition("file").sortWithinPartitions("file", "event_id").select("value", "file").write.partitionBy("file").text(folder)
    rows = spark.read.text(folder).select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("bigint").alias("event_id"))
    return with_sequence(rows)


# -- joins --------------------------------------------------------------------------------------

def _rich(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0")


@register("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def repartition_semi_join(spark, sf):
    return joins.semi_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), _rich(spark, sf), "o_custkey", "c_custkey")


@register("SELECT o_orderkey, o_custkey, o_orderpriority, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def repartition_inner_join(spark, sf):
    found = joins.repartition_join(table(spark, sf, "orders"), _rich(spark, sf), "o_custkey", "c_custkey")
    return found.select("o_orderkey", "o_custkey", "o_orderpriority", "c_name")


@register("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def copartitioned_join(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    right = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = joins.copartitioned(left, right, "k", n)
    return a.join(b.hint("merge"), "k").select("o_orderkey", "c_nationkey")


def _bloom_sides(spark, sf):
    r = _rich(spark, sf).select(F.col("c_nationkey").cast("bigint").alias("a"), F.col("c_custkey").alias("b"))
    return r, table(spark, sf, "orders").select(F.col("o_custkey").alias("b"), F.col("o_orderkey").alias("c"))


@register("SELECT b, CAST(c_nationkey AS BIGINT) AS a, c FROM (SELECT c_custkey AS b, c_nationkey FROM customer WHERE c_acctbal > 0) JOIN (SELECT o_custkey AS b, o_orderkey AS c FROM orders) USING (b)")
def bloom_join(spark, sf):
    return joins.bloom_join(*_bloom_sides(spark, sf))


@register("""WITH r AS (SELECT c_custkey AS b FROM customer WHERE c_acctbal > 0), s AS (SELECT o_custkey AS b FROM orders),
bits AS (SELECT DISTINCT b % 997 AS bit FROM r)
SELECT (SELECT count(*) FROM bits) AS bits_set, (SELECT count(*) FROM s WHERE b % 997 IN (SELECT bit FROM bits)) AS rows_shipped,
(SELECT count(*) FROM s WHERE b IN (SELECT b FROM r)) AS rows_matching, (SELECT count(*) FROM s) AS rows_total,
CAST(125 AS BIGINT) AS bytes_from_r, (SELECT 8 * (count(*) + count(DISTINCT b)) FROM s WHERE b % 997 IN (SELECT bit FROM bits)) AS bytes_from_s""")
def bloom_reduction_stats(spark, sf):
    return joins.reduction_stats(*_bloom_sides(spark, sf), buckets=997)


@register("SELECT 3 * i AS b, 2 * i AS a, 4 * i AS c FROM range(100) t(i)")
def bloom_join_inline(spark, sf):
    return joins.bloom_join(*inline_relations(spark))


@register("SELECT o_custkey AS b, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS values FROM orders GROUP BY 1")
def grouped_values(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("b"), F.col("o_orderkey").alias("c"))
    return joins.grouped_values(s).select("b", F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))).alias("values"))


# -- skyline ------------------------------------------------------------------------------------

_SKYLINE = "SELECT {cols} FROM {t} a WHERE NOT EXISTS (SELECT 1 FROM {t} b WHERE {le} AND ({lt}))"


def _not_exists(t: str, dims: list[str], cols: str) -> str:
    return _SKYLINE.format(t=t, cols=cols, le=" AND ".join(f"b.{d} <= a.{d}" for d in dims), lt=" OR ".join(f"b.{d} < a.{d}" for d in dims))


def _goods(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")


@register(_not_exists("part", ["p_size", "p_retailprice"], "p_partkey, p_size, p_retailprice"))
def skyline_nl(spark, sf):
    return skyline.skyline_nested(_goods(spark, sf), ["p_size", "p_retailprice"])


@register(_not_exists("part", ["p_size", "p_retailprice"], "p_partkey, p_size, p_retailprice"))
def skyline_sort(spark, sf):
    return skyline.skyline_sorted(_goods(spark, sf), "p_size", "p_retailprice")


@register(_not_exists("part", ["p_size", "p_retailprice"], "p_partkey, p_size, p_retailprice"))
def skyline_dc(spark, sf):
    return skyline.skyline_local_global(_goods(spark, sf), ["p_size", "p_retailprice"])


_ORDERS = "(SELECT o_orderkey, o_totalprice AS price, o_custkey AS age FROM orders)"


_EDGES_OF_RANGE = "CASE WHEN o_custkey % 50 = 0 THEN CAST('infinity' AS DOUBLE) WHEN o_custkey % 50 = 1 THEN 0 ELSE o_totalprice END"


@register(f"""WITH o AS (SELECT o_orderkey, 9007199254740992 - o_custkey % 3 + o_orderkey % 2 * 2 AS x, {_EDGES_OF_RANGE} AS y FROM orders), m AS (SELECT x, min(y) AS y FROM o GROUP BY 1)
SELECT o_orderkey, o.x, o.y FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.x <= o.x AND m.y <= o.y AND (m.x < o.x OR m.y < o.y))""")
def skyline_edges_of_range(spark, sf):
    """Integers around 2^53, which doubles don't tell apart, and infinity."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "9007199254740992 - o_custkey % 3 + o_orderkey % 2 * 2 AS x", f"{_EDGES_OF_RANGE} AS y")
    return skyline.skyline_local_global(rows, ["x", "y"])


@register(f"""WITH o AS {_ORDERS}, m AS (SELECT price, min(age) AS age FROM o GROUP BY 1),
s AS (SELECT price, age, min(age) OVER (ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM m)
SELECT o_orderkey, o.price, o.age FROM o JOIN s ON o.price = s.price AND o.age = s.age WHERE low IS NULL OR s.age < low""")
def skyline_sort_orders(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("age"))
    return skyline.skyline_sorted(rows, "price", "age")


# the least price of each (discount, tax), of which there are few, decides
@register("""WITH m AS (SELECT l_discount, l_tax, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2),
s AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.l_discount <= a.l_discount AND b.l_tax <= a.l_tax AND b.l_extendedprice <= a.l_extendedprice
AND (b.l_discount < a.l_discount OR b.l_tax < a.l_tax OR b.l_extendedprice < a.l_extendedprice)))
SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_extendedprice FROM lineitem JOIN s USING (l_discount, l_tax, l_extendedprice)""")
def skyline_dc_three(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_extendedprice")
    return skyline.skyline_local_global(rows, ["l_discount", "l_tax", "l_extendedprice"])


@register("""SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey
WHERE NOT (a.n_regionkey <= b.n_regionkey AND a.n_name <= b.n_name AND (a.n_regionkey < b.n_regionkey OR a.n_name < b.n_name))
AND NOT (b.n_regionkey <= a.n_regionkey AND b.n_name <= a.n_name AND (b.n_regionkey < a.n_regionkey OR b.n_name < a.n_name))""")
def skyline_incomparable(spark, sf):
    """Pairs of nations neither of which comes first in both region and name: a report on the
    predicate itself, over a table of fixed size."""
    s = table(spark, sf, "nation")
    a, b = (s.select(F.col("n_nationkey").alias(n), F.col("n_regionkey").alias(f"{n}1"), F.col("n_name").alias(f"{n}2")) for n in "xy")
    return a.join(b, (F.col("x") < F.col("y")) & skyline.incomparable([F.col("x1"), F.col("x2")], [F.col("y1"), F.col("y2")])).select("x", "y")


# -- windows and frequencies --------------------------------------------------------------------

W, ERROR = 1000, 0.01
S = frequency.block_size(W, ERROR)


def _stream(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))


def _queries(spark, sf):
    return _stream(spark, sf).where("seq % 97 = 0").select(F.col("seq").alias("t"), "key", F.expr("40 + (seq * 37) % 960").alias("w"))


_Q = "q AS (SELECT event_id AS t, user_id AS key, 40 + (event_id * 37) % 960 AS w FROM events WHERE event_id % 97 = 0), e AS (SELECT event_id AS seq, user_id AS key FROM events)"


@register(f"SELECT event_id AS seq, user_id AS key, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS n FROM events")
def window_freq_running(spark, sf):
    return frequency.window_running(_stream(spark, sf), W)


@register(f"WITH {_Q} SELECT t, key, {W} AS w, (SELECT count(*) FROM e WHERE e.key = q.key AND seq > t - {W} AND seq <= t) AS n FROM q")
def window_freq_exact(spark, sf):
    return frequency.window_exact(_stream(spark, sf), _queries(spark, sf).withColumn("w", F.lit(W)))


@register(f"WITH {_Q} SELECT t, key, w, (SELECT count(*) FROM e WHERE e.key = q.key AND seq > t - w AND seq <= t) AS n FROM q")
def window_freq_subwindow(spark, sf):
    return frequency.window_exact(_stream(spark, sf), _queries(spark, sf))


@register(f"""WITH {_Q}, p AS (SELECT *, t // {S} AS j, w - (t % {S} + 1) AS f FROM q), z AS (SELECT *, CASE WHEN f > 0 THEN f // {S} ELSE 0 END AS k, CASE WHEN f > 0 THEN f % {S} ELSE 0 END AS r FROM p),
b AS (SELECT seq // {S} AS blk, key, count(*) AS n FROM e GROUP BY 1, 2)
SELECT t, key, w, CAST(coalesce((SELECT sum(CASE WHEN blk >= j - k THEN n ELSE n // 2 END) FROM b WHERE b.key = z.key AND f > 0 AND blk < j AND (blk >= j - k OR (r > 0 AND blk = j - k - 1))), 0)
+ (SELECT count(*) FROM e WHERE e.key = z.key AND seq // {S} = j AND seq <= t AND seq > t - w) AS BIGINT) AS est FROM z""")
def jumping_window(spark, sf):
    return frequency.jumping_window(_stream(spark, sf), _queries(spark, sf), W, ERROR)


@register(f"SELECT event_id // {S} AS blk, user_id AS key, count(*) AS n FROM events GROUP BY 1, 2")
def window_block_counts(spark, sf):
    return frequency.block_counts(_stream(spark, sf), S)


@register(f"WITH {_Q} SELECT t, key, (SELECT count(*) FROM e WHERE e.key = q.key AND seq <= t) AS n FROM q")
def point_freq(spark, sf):
    return frequency.point_frequency(_stream(spark, sf), _queries(spark, sf).drop("w"))


@register(f"WITH {_Q} SELECT string_agg(CAST((SELECT count(*) FROM e WHERE e.key = q.key AND seq <= t) AS VARCHAR), ',' ORDER BY t) AS line FROM q")
def point_freq_answer_line(spark, sf):
    return answer_line(point_freq(spark, sf), "t", "n")


# -- sketches -----------------------------------------------------------------------------------

PLAN = sketches.plan(0.01, 0.9, 4_000, 0.1)
_CM = " UNION ALL ".join(f"SELECT {i} AS row, CAST({linear_sql('key', a, b, PLAN['width'])} AS BIGINT) AS cell, key FROM {{t}}" for i, (a, b) in enumerate(seeds(PLAN["depth"])))
_BF = " UNION ALL ".join(f"SELECT {i} AS row, CAST({linear_sql('key', a, b, PLAN['bits'])} AS BIGINT) AS pos, key FROM {{t}}" for i, (a, b) in enumerate(seeds(PLAN["hashes"], 54321)))
#: Keys that are asked for: those seen, and as many never seen.
_ASKED = "asked AS (SELECT DISTINCT user_id AS key FROM events UNION ALL SELECT DISTINCT user_id + 1000000 FROM events)"
_SKETCH = f"""e AS (SELECT user_id AS key FROM events), {_ASKED}, cm AS (SELECT row, cell, count(*) AS n FROM ({_CM.format(t='e')}) GROUP BY 1, 2),
bf AS (SELECT DISTINCT pos FROM ({_BF.format(t='e')})),
est AS (SELECT key, min(coalesce(n, 0)) AS est FROM ({_CM.format(t='asked')}) p LEFT JOIN cm USING (row, cell) GROUP BY 1),
mem AS (SELECT key, count(bf.pos) = count(*) AS member FROM ({_BF.format(t='asked')}) p LEFT JOIN bf USING (pos) GROUP BY 1)"""


def _asked(spark, sf):
    seen = _stream(spark, sf).select("key").distinct()
    return seen.unionByName(seen.select((F.col("key") + 1_000_000).alias("key")))


def _count_min(spark, sf):
    return sketches.count_min(_stream(spark, sf), "key", PLAN["depth"], PLAN["width"])


def _bloom(spark, sf):
    return sketches.bloom(_stream(spark, sf), "key", PLAN["bits"], PLAN["hashes"])


@register(f"WITH {_SKETCH} SELECT * FROM cm")
def count_min_sketch(spark, sf):
    return _count_min(spark, sf)


@register(f"WITH {_SKETCH} SELECT * FROM est")
def count_min(spark, sf):
    return sketches.count_min_estimate(_count_min(spark, sf), _asked(spark, sf), "key", PLAN["depth"], PLAN["width"])


@register(f"WITH {_SKETCH} SELECT * FROM mem")
def bloom_membership(spark, sf):
    return sketches.bloom_contains(_bloom(spark, sf), _asked(spark, sf), "key", PLAN["bits"], PLAN["hashes"])


@register(f"WITH {_SKETCH} SELECT key, CASE WHEN member THEN est ELSE 0 END AS est FROM est JOIN mem USING (key)")
def cm_with_bloom(spark, sf):
    return sketches.guarded_estimate(_count_min(spark, sf), _bloom(spark, sf), _asked(spark, sf), "key", PLAN["depth"], PLAN["width"], PLAN["bits"], PLAN["hashes"])


_AT = f"""{_Q}, cm AS ({_CM.format(t='e')}), first AS (SELECT pos, min(seq) AS since FROM (SELECT * FROM ({_BF.format(t='e')}) JOIN (SELECT key, min(seq) AS seq FROM e GROUP BY 1) USING (key)) GROUP BY 1),
est AS (SELECT t, key, min(n) AS low FROM (SELECT p.t, p.key, p.row, (SELECT count(*) FROM hit WHERE hit.row = p.row AND hit.cell = p.cell AND hit.seq <= p.t) AS n FROM ({_CM.format(t='q').replace(', key FROM', ', key, t FROM')}) p) GROUP BY 1, 2),
mem AS (SELECT t, key, count(CASE WHEN since <= t THEN 1 END) = count(*) AS member FROM ({_BF.format(t='q').replace(', key FROM', ', key, t FROM')}) p LEFT JOIN first USING (pos) GROUP BY 1, 2)"""


@register(f"WITH hit AS ({_CM.format(t='(SELECT event_id AS seq, user_id AS key FROM events)').replace(', key FROM', ', seq FROM')}), {_AT} SELECT t, key, CASE WHEN member THEN low ELSE 0 END AS est FROM est JOIN mem USING (t, key)")
def cm_point_in_time(spark, sf):
    return sketches.estimate_at(_stream(spark, sf), _queries(spark, sf).drop("w"), PLAN["depth"], PLAN["width"], PLAN["bits"], PLAN["hashes"])


# -- addresses and ranges -----------------------------------------------------------------------

_IP = "(user_id * 2654435761) % 4294967296"


def _addresses(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(_IP).alias("x"))


@register(f"SELECT event_id, x, concat(x >> 24, '.', (x >> 16) & 255, '.', (x >> 8) & 255, '.', x & 255) AS ip, CAST(x >> 24 AS INTEGER) AS prefix, x AS back FROM (SELECT event_id, CAST({_IP} AS BIGINT) AS x FROM events)")
def ip_parse(spark, sf):
    return _addresses(spark, sf).withColumn("ip", long_to_ipv4(F.col("x"))).withColumn("prefix", first_octet(F.col("ip"))).withColumn("back", ipv4_to_long(F.col("ip")))


def _ranges(spark, sf):
    lo = F.expr("(event_id * 1103515245) % 4294967296")
    return table(spark, sf, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("id"), lo.alias("l")).withColumn("r", F.expr("least(l + id * 3001, 4294967295)"))


_R = "q AS (SELECT event_id AS id, CAST((event_id * 1103515245) % 4294967296 AS BIGINT) AS l, CAST(least((event_id * 1103515245) % 4294967296 + event_id * 3001, 4294967295) AS BIGINT) AS r FROM events WHERE event_id % 5 = 0)"
_COVER = f"""{_R}, n AS (SELECT id, CAST(h AS INTEGER) AS h, (l + (CAST(1 AS BIGINT) << h) - 1) >> h AS lo, (r + 1) >> h AS hi FROM q, (SELECT CAST(i AS INTEGER) AS h FROM range(33) t(i))),
cov AS (SELECT id, h, lo AS node FROM n WHERE lo < hi AND lo % 2 = 1 UNION ALL SELECT id, h, hi - 1 FROM n WHERE lo < hi AND hi % 2 = 1)"""


@register(f"WITH {_COVER} SELECT id, h, node FROM cov")
def dyadic_cover(spark, sf):
    return ranges.cover(_ranges(spark, sf))


@register(f"WITH {_R}, k AS (SELECT DISTINCT CAST({_IP} AS BIGINT) AS x FROM events) SELECT id, l, r, EXISTS (SELECT 1 FROM k WHERE x BETWEEN l AND r) AS found FROM q")
def range_exists(spark, sf):
    return ranges.exists_in_range(_ranges(spark, sf), _addresses(spark, sf), "x")


LEVELS = ranges.level_sizes(2_000, 0.1)
_PAIRS = seeds(max(k for _, k in LEVELS), 777)


def _level_sql(source: str) -> str:
    """The positions of every (h, node) of ``source``: parameters of each (level, hash) as a table."""
    rows = ", ".join(f"({h}, {i}, {a}, {b}, {bits})" for h, (bits, k) in enumerate(LEVELS) for i, (a, b) in enumerate(_PAIRS[:k]))
    return f"SELECT s.*, p.i, ((p.a * (s.node % 2147483647) + p.b) % 2147483647) % p.bits AS pos FROM {source} s JOIN (VALUES {rows}) p(h, i, a, b, bits) ON s.h = p.h"


@register(f"""WITH {_COVER}, k AS (SELECT DISTINCT CAST({_IP} AS BIGINT) AS x FROM events), pre AS (SELECT DISTINCT CAST(h AS INTEGER) AS h, x >> h AS node FROM k, (SELECT CAST(i AS INTEGER) AS h FROM range(33) t(i))),
bits AS (SELECT DISTINCT h, pos FROM ({_level_sql('pre')})), nodes AS (SELECT id, c.h, node, count(bits.pos) = count(*) AS hit FROM ({_level_sql('cov')}) c LEFT JOIN bits ON c.h = bits.h AND c.pos = bits.pos GROUP BY 1, 2, 3)
SELECT q.id, l, r, coalesce(bool_or(hit), false) AS found FROM q LEFT JOIN nodes USING (id) GROUP BY 1, 2, 3""")
def range_bloom(spark, sf):
    return ranges.range_bloom(_ranges(spark, sf), ranges.range_filters(_addresses(spark, sf), "x", LEVELS), LEVELS)


# -- transactions -------------------------------------------------------------------------------
# five consecutive events are one transaction; every third event writes its key, the others read it

_TX = "tx AS (SELECT event_id AS id, event_id // 5 + 1 AS xact, user_id AS key, event_id % 3 = 0 AS writes FROM events)"
_V = f"{_TX}, v AS (SELECT key, xact AS wts, max(id) AS value FROM tx WHERE writes GROUP BY 1, 2), rd AS (SELECT id, xact, key FROM tx WHERE NOT writes)"
_SEEN = "seen AS (SELECT rd.id, rd.xact, rd.key, max(v.wts) AS wts, arg_max(v.value, v.wts) AS value FROM rd LEFT JOIN v ON v.key = rd.key AND v.wts <= rd.xact GROUP BY 1, 2, 3)"
_RTS = "rts AS (SELECT v.key, v.wts, greatest(v.wts, coalesce(max(s.xact), v.wts)) AS rts FROM v LEFT JOIN seen s ON s.key = v.key AND s.wts = v.wts GROUP BY 1, 2)"


def _tx(spark, sf):
    tx = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr("event_id div 5 + 1").alias("xact"), F.col("user_id").alias("key"))
    writes = tx.where("id % 3 = 0")
    versions = writes.groupBy("key", F.col("xact").alias("wts")).agg(F.max("id").alias("value"))
    return tx.where("id % 3 <> 0"), writes, versions


@register(f"WITH {_V}, {_SEEN} SELECT id, xact, key, coalesce(wts, -1) AS wts, coalesce(value, -1) AS value FROM seen")
def mvto_asof_read(spark, sf):
    """-1 stands for reads that see nothing."""
    reads, _, versions = _tx(spark, sf)
    return mvto.asof_reads(reads, versions).fillna(-1, ["wts", "value"])


@register(f"WITH {_V}, {_SEEN}, {_RTS} SELECT * FROM rts")
def mvto_rts(spark, sf):
    reads, _, versions = _tx(spark, sf)
    return mvto.read_timestamps(reads, versions)


_LATE = "w AS (SELECT id, greatest(1, xact - 40) AS xact, key FROM tx WHERE writes)"


@register(f"""WITH {_V}, {_SEEN}, {_RTS}, {_LATE}, a AS (SELECT w.id, w.xact, w.key, max(rts.wts) AS wts, arg_max(rts.rts, rts.wts) AS rts FROM w JOIN rts ON rts.key = w.key AND rts.wts <= w.xact GROUP BY 1, 2, 3)
SELECT * FROM a WHERE rts > xact""")
def mvto_write_conflicts(spark, sf):
    """Writes that arrive forty transactions late."""
    reads, writes, versions = _tx(spark, sf)
    late = writes.withColumn("xact", F.greatest(F.lit(1), F.col("xact") - 40))
    return mvto.write_conflicts(late, reads, versions)


_EDGES = f"{_V}, {_SEEN}, edge AS (SELECT DISTINCT xact AS reader, wts AS writer FROM seen WHERE wts <> xact)"


@register(f"WITH {_EDGES} SELECT * FROM edge")
def mvto_reads_from(spark, sf):
    reads, _, versions = _tx(spark, sf)
    return mvto.reads_from(reads, versions)


def _dead(spark, sf):
    reads, _, versions = _tx(spark, sf)
    aborted = versions.where("wts % 500 = 7").select(F.col("wts").alias("xact"))
    return mvto.cascade(mvto.reads_from(reads, versions), aborted), versions


_DEAD = f"WITH RECURSIVE {_EDGES}, dead AS (SELECT DISTINCT wts AS xact FROM v WHERE wts % 500 = 7 UNION SELECT reader FROM edge JOIN dead ON writer = dead.xact)"


@register(f"{_DEAD} SELECT xact FROM dead")
def mvto_cascade(spark, sf):
    return _dead(spark, sf)[0]


@register(f"{_DEAD} SELECT key, wts, value FROM v WHERE wts NOT IN (SELECT xact FROM dead)")
def mvto_live_versions(spark, sf):
    dead, versions = _dead(spark, sf)
    return mvto.live_versions(versions, dead)


@register()
def mvto_replay(spark, sf):
    """A schedule for each of 64 shards of keys: every event a transaction of begin, one operation
    and, for most, commit; a commit that comes late leaves readers pending."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.expr("user_id % 64").alias("shard"))
    op = F.expr("CASE id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'write' ELSE 'read' END")
    end = F.expr("CASE WHEN id % 11 = 3 THEN 'rollback' ELSE 'commit' END")
    steps = F.array(F.struct(F.lit(0).alias("o"), F.lit("begin").alias("op")), F.struct(F.lit(1).alias("o"), op.alias("op")), F.struct(F.expr("CASE WHEN id % 7 = 0 THEN 600 ELSE 2 END").alias("o"), end.alias("op")))
    log = e.select("shard", "id", "key", F.explode(steps).alias("s"))
    return mvto.replay(log.select("shard", F.expr("id * 3 + s.o").alias("seq"), F.expr("id + 1").alias("xact"), "s.op", "key", F.col("id").alias("value")))


# -- streaming ----------------------------------------------------------------------------------

def _live(spark, sf):
    return live.read_events(spark, f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))


@register(SQL["window_block_counts"])
def stream_block_counts(spark, sf):
    return live.run_available(live.block_counts(_live(spark, sf), S), spark, "blocks")


@register(SQL["point_freq"])
def stream_point_freq(spark, sf):
    asked = _queries(spark, sf).drop("w")
    terms = live.run_available(live.block_terms(_live(spark, sf), asked, 512), spark, "points")
    return live.point_frequency(terms, asked, 512)


@register(SQL["window_freq_subwindow"])
def stream_window_freq(spark, sf):
    """Every query's own event is in its window, so each has a row."""
    return live.run_available(live.window_frequency(_live(spark, sf), _queries(spark, sf)), spark, "windows")
