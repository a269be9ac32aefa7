"""Properties and edge cases of the engine's operators."""

import ipaddress
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import PRIME, linear, seeds
from tessera.functions.net import first_octet, ipv4_to_long, long_to_ipv4
from tessera.operators import frequency, joins, mvto, ranges, select, sketches, skyline
from tessera.plans import catalogue
from tessera.sources import readers, writers
from tessera.streaming import frequency as live


def rows(frame):
    return sorted(map(tuple, frame.collect()))


# -- sources, sinks, selection

def test_declared_schema():
    assert readers.declared_schema("a:Integer, b:Float,c:String").simpleString() == "struct<a:int,b:float,c:string>"
    for bad in ("a", "a:Double", "a:Integer,a:Float", ""):
        with pytest.raises(ValueError):
            readers.declared_schema(bad)


def test_delimited_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('1,2.5,x y\n2,0.1,"q\n3,7,\n')
    frame = readers.delimited(spark, f"{tmp_path}/in.csv", "n:Integer,f:Float,s:String")
    assert [r.n for r in select.select_where(frame, ["n"], "f|>=|0.1,f|<|3").collect()] == [1, 2]
    assert select.select_where(frame, ["s", "n"], "s|=|x y").collect()[0].s == "x y"
    writers.write_ordered(frame.select("s", "n"), ["n"], f"{tmp_path}/out", drop=["n"], single=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().splitlines() == ["x y", '"q', ""]
    writers.write_unordered(frame, f"{tmp_path}/all", single=True)
    assert rows(readers.delimited(spark, f"{tmp_path}/all", "n:Integer,f:Float,s:String").select("n")) == [(1,), (2,), (3,)]
    (tmp_path / "bad.csv").write_text("x,1,1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.delimited(spark, f"{tmp_path}/bad.csv", "n:Integer,f:Float,s:String").collect()


def test_event_and_query_files(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("1.2.3.4\tx\n\n5.6.7.8\ty\n1.2.3.4\tz\n")
    assert rows(readers.events(spark, f"{tmp_path}/e.tsv").select("seq", "ip")) == [(0, "1.2.3.4"), (1, "5.6.7.8"), (2, "1.2.3.4")]
    (tmp_path / "q.txt").write_text("2 1.2.3.4 7\n\n5  9.9.9.9\n")
    assert rows(readers.point_queries(spark, f"{tmp_path}/q.txt")) == [(2, "1.2.3.4", 7), (5, "9.9.9.9", 0)]
    (tmp_path / "r.txt").write_text("1.0.0.0\t1.0.0.9\n2.0.0.0 3.0.0.0\n")
    assert rows(readers.range_queries(spark, f"{tmp_path}/r.txt").select("id", "ip_hi")) == [(0, "1.0.0.9"), (1, "3.0.0.0")]
    (tmp_path / "car.csv").write_text("10|2\n5|9\n")
    assert rows(readers.tuples(spark, f"{tmp_path}/car.csv")) == [(5, 9), (10, 2)]
    writers.write_answer_line(spark.createDataFrame([(2, True), (1, False)], "t int, v boolean"), "t", "v", f"{tmp_path}/line")
    assert spark.read.text(f"{tmp_path}/line").collect()[0].value == "false,true"
    assert writers.answer_line(spark.createDataFrame([], "t int, v int"), "t", "v").collect()[0].line == ""


def test_sequence_over_many_partitions(spark):
    frame = spark.range(0, 1000, 1, 7).select((F.col("id") * 2).alias("x"))
    assert [(r.x, r.seq) for r in readers.with_sequence(frame).orderBy("x").collect()] == [(2 * i, i) for i in range(1000)]


def test_sequence_over_a_folder(spark, tmp_path):
    """Files count in the order of their names, not of their sizes; a file of many splits too."""
    sizes = {"a.tsv": 1, "b.tsv": 50, "c.tsv": 3000, "d.tsv": 2}
    lines = [f"{name}-{i}" for name, n in sizes.items() for i in range(n)]
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{name}-{i}\trest\n" + "\n" * (i % 2) for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.seq: r.ip for r in readers.events(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [got[i] for i in range(len(got))] == lines


def test_where_text():
    assert select.parse_where("attr1|=|3,attr2|<| 7") == [("attr1", "=", "3"), ("attr2", "<", " 7")]
    assert select.parse_where("") == []
    for bad in ("a|!=|1", "a=1", "a|=|1,"):
        with pytest.raises(ValueError):
            select.parse_where(bad)


def test_select_edges(spark):
    frame = spark.createDataFrame([(1, "", None), (2, "b", 5)], "n int, s string, m int")
    assert rows(select.select_where(frame, ["s", "n", "s"], "")) == [("", 1, ""), ("b", 2, "b")]
    assert rows(select.select_where(frame, ["n"], "m|>=|0")) == [(2,)]
    for columns, where in ((["x"], ""), ([], ""), (["n"], "x|=|1")):
        with pytest.raises(ValueError):
            select.select_where(frame, columns, where)
    codes = select.dictionary(frame, "s")
    assert rows(codes) == [("", 0), ("b", 1)]
    coded = select.encode(frame, "s", codes)
    assert rows(select.encoded_where(coded, "s", codes, "=", "unseen").select("n")) == []
    assert rows(select.encoded_where(coded, "s", codes, "<", "unseen").select("n")) == [(1,), (2,)]


# -- joins

def test_bloom_join_keys(spark):
    r = spark.createDataFrame([(1, 5), (2, 10_005), (3, -7), (4, -7)], "a long, b long")
    s = spark.createDataFrame([(5, 50), (10_005, 60), (-7, 70), (-7, 71), (20_005, 80)], "b long, c long")
    want = [(5, 1, 50), (10_005, 2, 60), *((-7, a, c) for a in (3, 4) for c in (70, 71))]
    assert rows(joins.bloom_join(r, s)) == sorted(want)
    stats = joins.reduction_stats(r, s).collect()[0]
    assert (stats.rows_shipped, stats.rows_matching, stats.rows_total) == (5, 4, 5)
    assert rows(joins.bloom_join(*readers.inline_relations(spark))) == [(3 * i, 2 * i, 4 * i) for i in range(100)]


def test_as_of_brute_force(spark):
    rng = random.Random(1)
    versions = {(rng.randrange(4), rng.randrange(300)): rng.randrange(99) for _ in range(150)}
    points = [(i, rng.randrange(5), rng.randrange(-5, 320)) for i in range(200)]
    v = spark.createDataFrame([(k, w, x) for (k, w), x in versions.items()], "key long, wts long, value long")
    p = spark.createDataFrame(points, "id long, key long, seq long")
    want = []
    for i, k, t in points:
        seen = [w for (kk, w) in versions if kk == k and w <= t]
        want.append((i, k, t, max(seen, default=None), versions[k, max(seen)] if seen else None))
    got = [tuple(r) for r in joins.as_of(p, v, 16).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    counts = {r.id: r.n for r in joins.counts_up_to(v.select("key", F.col("wts").alias("seq")), p, 16).collect()}
    assert counts == {i: sum(kk == k and w <= t for kk, w in versions) for i, k, t in points}


# -- skyline

@pytest.mark.parametrize("kind", ["random", "ties", "one", "empty"])
def test_skylines_agree(spark, kind):
    rng = random.Random(2)
    data = {"random": [(rng.randrange(1000), rng.randrange(1000)) for _ in range(800)], "ties": [(rng.randrange(4), rng.randrange(4)) for _ in range(300)], "one": [(1, 1)], "empty": []}[kind]
    frame = spark.createDataFrame([*data, (None, 1)] if data else data, "price int, age int")
    want = sorted(a for a in data if not any(b[0] <= a[0] and b[1] <= a[1] and b != a for b in data))
    assert rows(skyline.skyline_nested(frame.where("price IS NOT NULL"), ["price", "age"])) == want
    assert rows(skyline.skyline_sorted(frame, "price", "age")) == want
    assert rows(skyline.skyline_local_global(frame, ["price", "age"], block=100)) == want


def test_skylines_of_exact_values(spark):
    big = 2**53
    data = [(big + 1, 5.0), (big, 6.0), (big + 1, 6.0), (1, float("inf")), (3, float("inf")), (big + 2, float("nan")), (0, float("nan"))]
    frame = spark.createDataFrame(data, "x long, y double")
    want = [(0, "nan"), (1, "inf"), (big, "6.0"), (big + 1, "5.0")]
    for got in (skyline.skyline_sorted(frame, "x", "y"), skyline.skyline_local_global(frame, ["x", "y"]), skyline.skyline_nested(frame, ["x", "y"])):
        assert sorted((r.x, str(r.y)) for r in got.collect()) == want
    assert rows(skyline.skyline_sorted(spark.createDataFrame([(1, float("inf"))], "x long, y double"), "x", "y")) == [(1, float("inf"))]
    swapped = frame.where("x > 2").select("y", "x")
    assert sorted(r.x for r in skyline.skyline_local_global(swapped, ["y", "x"], block=2).collect()) == sorted(r.x for r in skyline.skyline_nested(swapped, ["y", "x"]).collect())
    words = spark.createDataFrame([("b", 2), ("a", 3), ("c", 1), ("c", 2)], "s string, n int")
    assert rows(skyline.skyline_local_global(words, ["s", "n"])) == [("a", 3), ("b", 2), ("c", 1)]


def test_nested_beyond_its_limit(spark, monkeypatch):
    monkeypatch.setattr(skyline, "NESTED", 2)
    frame = spark.createDataFrame([(1, 5), (2, 4), (2, 6), (None, 1)], "a int, b int")
    assert sorted(map(repr, skyline.skyline_nested(frame, ["a", "b"]).collect())) == ["Row(a=1, b=5)", "Row(a=2, b=4)", "Row(a=None, b=1)"]


def test_skyline_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(skyline, "MERGE", 2)
    data = [(i, 400 - i, i * 7 % 5) for i in range(400)] * 2 + [(i, 500, 9) for i in range(400)]
    frame = spark.createDataFrame(data, "a int, b int, c int").repartition(9)
    assert rows(skyline.skyline_local_global(frame, ["a", "b", "c"], block=50)) == sorted(data[:800])


# -- frequencies

def test_jumping_window_bound(spark):
    rng = random.Random(3)
    stream = [(i, rng.choice([1, 1, 1, 2, 3])) for i in range(3000)]
    asked = [(t, k, w) for t in range(5, 3000, 61) for k in (1, 2, 9) for w in (0, 15, 333, 1000)]
    e = spark.createDataFrame(stream, "seq long, key long").repartition(3)
    got = {(r.t, r.key, r.w): r.est for r in frequency.jumping_window(e, spark.createDataFrame(asked, "t long, key long, w long"), 1000, 0.01).collect()}
    assert len(got) == len(asked)
    for t, k, w in asked:
        exact = sum(1 for i, x in stream if x == k and t - (w or 1000) < i <= t)
        assert abs(got[t, k, w] - exact) <= 10
    exact = {(r.t, r.key, r.w): r.n for r in frequency.window_exact(e, spark.createDataFrame(asked, "t long, key long, w long").where("w > 0"), block=50).collect()}
    assert exact == {(t, k, w): sum(1 for i, x in stream if x == k and t - w < i <= t) for t, k, w in asked if w}
    for window, error in ((0, 0.01), (40, 0.01)):
        with pytest.raises(ValueError):
            frequency.block_size(window, error)
    with pytest.raises(Exception, match="out of range"):
        frequency.jumping_window(e, spark.createDataFrame([(5, 1, 2000)], "t long, key long, w long"), 1000, 0.01).collect()


# -- sketches and ranges

def test_sizes():
    assert sketches.count_min_size(0.01, 0.9) == (3, 272)
    assert sketches.bloom_size(400_000, 0.1) == (1_917_012, 4)
    assert sketches.plan(0.01, 0.9, 400_000, 0.1)["bytes"] < 10_000_000
    with pytest.raises(ValueError):
        sketches.plan(0.01, 0.9, 400_000_000, 0.1)
    assert ranges.level_sizes(400_000, 0.1)[32][0] >= 1
    assert all(0 < a < PRIME and 0 <= b < PRIME for a, b in seeds(50)) and seeds(3) == seeds(3)


def test_sketches_are_one_sided(spark):
    rng = random.Random(4)
    keys = [int(rng.paretovariate(0.7)) for _ in range(5000)]
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    asked = spark.createDataFrame([(k,) for k in sorted(set(keys))] + [(-i,) for i in range(1, 400)], "key long")
    est = {r.key: r.est for r in sketches.count_min_estimate(sketches.count_min(frame, "key", 3, 272), asked, "key", 3, 272).collect()}
    assert all(est[k] >= keys.count(k) for k in set(keys))
    bits, hashes = sketches.bloom_size(len(set(keys)), 0.1)
    member = {r.key: r.member for r in sketches.bloom_contains(sketches.bloom(frame, "key", bits, hashes), asked, "key", bits, hashes).collect()}
    assert all(member[k] for k in keys)
    assert sum(member[-i] for i in range(1, 400)) < 100
    assert linear(F.lit(5), 1, 0, 10) is not None


def test_cover_is_disjoint_and_complete(spark):
    top = 2**32 - 1
    cases = [(1, 14), (0, top), (5, 5), (9, 3), (top, top), (0, 0), (28753322, 29081060), *itertools.combinations(range(12), 2)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "id long, l long, r long")
    found = {}
    for r in ranges.cover(frame).collect():
        found.setdefault(r.id, []).append((r.node << r.h, (r.node + 1 << r.h) - 1))
    for i, (a, b) in enumerate(cases):
        parts = sorted(found.get(i, []))
        if a > b:
            assert not parts
            continue
        assert parts[0][0] == a and parts[-1][1] == b and len(parts) <= 64
        assert all(x[1] + 1 == y[0] for x, y in itertools.pairwise(parts))
    keys = spark.createDataFrame([(13,), (13,), (top,)], "k long")
    want = [any(a <= k <= b for k in (13, top)) for a, b in cases]
    assert [r.found for r in ranges.exists_in_range(frame, keys, "k").orderBy("id").collect()] == want
    sizes = ranges.level_sizes(100, 0.1)
    bloomed = [r.found for r in ranges.range_bloom(frame, ranges.range_filters(keys, "k", sizes), sizes).orderBy("id").collect()]
    assert all(b for w, b in zip(want, bloomed, strict=True) if w) and not bloomed[3]


def test_addresses(spark):
    ips = ["0.0.0.0", "255.255.255.255", "200.1.2.3", "10.0.0.255"]
    frame = spark.createDataFrame([(i,) for i in ips], "ip string").withColumn("n", ipv4_to_long(F.col("ip")))
    got = frame.select("ip", "n", long_to_ipv4(F.col("n")).alias("back"), first_octet(F.col("ip")).alias("o")).collect()
    assert all(r.n == int(ipaddress.ip_address(r.ip)) and r.back == r.ip and r.o == int(r.ip.split(".")[0]) for r in got)


# -- transactions

def test_store_visibility_and_late_write():
    s = mvto.Store()
    a, b = s.begin(), s.begin()
    s.insert(a, 1, 10)
    assert s.read(b, 1) == 10
    with pytest.raises(mvto.Refused):
        s.write(a, 1, 11)  # b has read the version a would replace
    assert s.status == {a: "aborted", b: "aborted"} and s.data == {}
    c = s.begin()
    s.insert(c, 1, 5)  # the key is free again
    s.write(c, 1, 6)
    assert s.read(c, 1) == 6 and s.commit(c) == "committed"
    d = s.begin()
    s.write(d, 1, 7)
    assert s.data[1] == {c: [6, c], d: [7, d]}


def test_store_pending_commits():
    s = mvto.Store()
    a, b, c = s.begin(), s.begin(), s.begin()
    s.insert(a, 1, 1)
    s.read(b, 1)
    s.write(b, 1, 2)
    assert s.read(c, 1) == 2
    assert s.commit(c) == "pending" and s.commit(b) == "pending"
    with pytest.raises(mvto.Refused):
        s.read(c, 1)  # no more operations after commit was asked for
    assert s.commit(a) == "committed" and set(s.status.values()) == {"committed"}
    with pytest.raises(mvto.Refused):
        s.rollback(a)


def test_store_cascade():
    s = mvto.Store()
    a, b, c, d = (s.begin() for _ in range(4))
    s.insert(a, 1, 1)
    s.read(b, 1)
    s.insert(b, 2, 2)
    s.read(c, 2)
    s.commit(c)
    s.insert(d, 3, 3)
    assert s.rollback(a) == [a, b, c] and s.status[d] == "active" and list(s.data) == [3]
    with pytest.raises(mvto.Refused):
        s.read(d, 1)
    assert s.status[d] == "aborted"
    for bad in (lambda: s.insert(9, 1, 1), lambda: s.begin(2), lambda: s.commit(a)):
        with pytest.raises(mvto.Refused):
            bad()


def test_replay_and_cascade_frames(spark):
    log = [(0, 1, 1, "begin", None, None), (0, 2, 1, "insert", 1, 10), (0, 3, 2, "begin", None, None), (0, 4, 2, "read", 1, None), (0, 5, 2, "commit", None, None), (0, 6, 1, "rollback", None, None), (0, 7, 1, "odd", None, None), (1, 1, 1, "begin", None, None), (1, 2, 1, "commit", None, None)]
    got = mvto.replay(spark.createDataFrame(log, "shard long, seq long, xact long, op string, key long, value long")).collect()
    by = {(r.shard, r.seq): r for r in got}
    assert by[0, 4].value == 10 and by[0, 4].final == "aborted" and by[0, 7].outcome == "refused" and by[1, 2].final == "committed"
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 12)] + [(50, 40)], "reader long, writer long")
    dead = mvto.cascade(edges, spark.createDataFrame([(8,), (8,)], "xact long"))
    assert rows(dead) == [(i,) for i in range(8, 13)]


class PlainStore:
    """The same protocol on one flat list of versions, written without the store's bookkeeping."""

    def __init__(self):
        self.latest, self.state, self.versions, self.read_from = 0, {}, [], []  # versions: [key, writer, value, latest reader]

    def do(self, op, x, key, value):
        if op == "begin":
            if x <= self.latest:
                return "refused", None
            self.latest, self.state[x] = x, "active"
            return "ok", None
        if op == "rollback":
            if self.state.get(x) not in ("active", "pending"):
                return "refused", None
            self.abort(x)
            return "ok", None
        if self.state.get(x) != "active":
            return "refused", None
        if op == "commit":
            self.state[x] = "pending"
            while free := [y for y, s in self.state.items() if s == "pending" and all(self.state[w] == "committed" for r, w in self.read_from if r == y)]:
                for y in free:
                    self.state[y] = "committed"
            return "ok", None
        own = [v for v in self.versions if v[0] == key]
        if op == "insert":
            if own:
                self.abort(x)
                return "refused", None
            self.versions.append([key, x, value, x])
            return "ok", None
        seen = max((v for v in own if v[1] <= x), key=lambda v: v[1], default=None)
        if seen is None or op == "write" and seen[3] > x:
            self.abort(x)
            return "refused", None
        if op == "read":
            seen[3] = max(seen[3], x)
            if seen[1] != x and self.state[seen[1]] != "committed":
                self.read_from.append((x, seen[1]))
            return "ok", seen[2]
        if seen[1] == x:
            seen[2] = value
        else:
            self.versions.append([key, x, value, x])
        return "ok", None

    def abort(self, x):
        if self.state.get(x) in ("active", "pending"):
            self.state[x] = "aborted"
            self.versions = [v for v in self.versions if v[1] != x]
            for r, w in list(self.read_from):
                if w == x:
                    self.abort(r)


def _same_as_plain(got):
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    for log in by_shard.values():
        store, outcomes = PlainStore(), []
        for r in sorted(log, key=lambda r: r.seq):
            outcomes.append((r, store.do(r.op, r.xact, r.key, r.given)))
        for r, (outcome, value) in outcomes:
            assert (r.outcome, r.value, r.final) == (outcome, value, store.state.get(r.xact)), r


def test_replay_against_a_plain_store(spark):
    """The registered schedule and random ones, row by row."""
    got = catalogue.QUERIES["mvto_replay"](spark, "/root/testdata/sf0.001").withColumn("given", F.expr("xact - 1"))
    assert got.count() == 3_000
    _same_as_plain(got.collect())
    rng, log = random.Random(9), []
    for shard in range(40):
        begun = 0
        for seq in range(rng.randrange(120)):
            op = rng.choice(["begin", "begin", "insert", "read", "read", "write", "write", "commit", "rollback"])
            begun += op == "begin"
            x = begun if op == "begin" and rng.random() < 0.95 else rng.randrange(max(1, begun - 6), begun + 2)
            log.append((shard, seq, x, op, rng.randrange(6), rng.randrange(100)))
    frame = spark.createDataFrame(log, "shard long, seq long, xact long, op string, key long, value long")
    given = frame.select("shard", "seq", F.col("value").alias("given"))
    _same_as_plain(mvto.replay(frame).join(given, ["shard", "seq"]).collect())


# -- streaming

def test_streams_over_many_batches(spark, tmp_path):
    frame = spark.range(500).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("key"))
    frame.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = live.read_events(spark, f"{tmp_path}/in")
    assert rows(live.run_available(live.block_counts(stream, 20), spark, "t")) == rows(frequency.block_counts(frame, 20).select("blk", "key", "n"))
    queries = spark.createDataFrame([(100, 3), (499, 0), (3, 5)], "t long, key long")
    terms = live.run_available(live.block_terms(live.read_events(spark, f"{tmp_path}/in"), queries, 32), spark, "t")
    assert rows(live.point_frequency(terms, queries, 32).select("t", "key", "n")) == rows(frequency.point_frequency(frame, queries).select("t", "key", "n"))
    windows = queries.selectExpr("t", "key", "t div 2 + 1 AS w")
    got = rows(live.run_available(live.window_frequency(live.read_events(spark, f"{tmp_path}/in"), windows), spark, "t").select("t", "key", "w", "n"))
    assert got == [(t, k, w, n) for t, k, w in sorted((t, k, t // 2 + 1) for t, k in [(100, 3), (499, 0), (3, 5)]) if (n := sum(i % 7 == k and t - w < i <= t for i in range(500)))]
