"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash fingerprints of the sets first, those within two bits by the grid of
segment counts (``simhash.links``).  Fingerprints of 64 bits can't find all: at 0.8 two texts differ
in about ten bits, and a grid within ten steps holds nearly everything.  So min-wise hashes add more:
``BANDS`` bands of ``ROWS`` minima each; sets that share a band are candidates (a pair at 0.8 shares
none with a chance of 5 in 100 million, a closer one less).  Sizes and one bit of each minimum
(``SAME`` of 128 must agree, seven standard deviations below what 0.8 leads one to expect) rule out
most others, and what remains is verified on the whole sets, exactly.

Bands of few sets are paired up.  Those of many are settled in rounds, some bands at a time: all
sets are held against one of them, what is similar becomes one component, and only sets of
different components are held against each other in the next round.  So a large group of near
copies costs links linear in its members.  What is apart still (many sets that are alike, but not
by 0.8) is joined exactly on its rarest shingles.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.scratch import Scratch, keep_winners, row_mark, slices, winners

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS, SAME = 4, 32, 92
#: Bands of more sets are held against one of them, some bands in each round.
PAIR_UP, ROUNDS = 16, ((0, 2), (2, 8), (8, BANDS))
#: Documents or pairs up to which they are broadcast, 24 bytes each.
BROADCAST_ROWS = 100_000


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased (A-Z) text's word shingles; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(words) - SHINGLE + 1))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more, in integers; empty sets are alike."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _rule() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the min-wise hashes."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, (2, ROWS * BANDS), np.uint64) * np.uint64(2) + np.uint64(1)
    return a, b


_TIMES, _PLUS = _rule()


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a set's bands, and one bit of each of its minima as two 64-bit words."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):
        np.minimum(least, (s[i : i + 256, None] * _TIMES + _PLUS).min(axis=0), out=least)
    bits = np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    band = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        band = (band ^ column) * np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(29)
    return band.view(np.int64), bits


def _sketches(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, mark, fp, sim, size, low, high, bands)``: a digest of the document's set, its SimHash, size and sketch."""
    from tessera.llm.simhash import majority

    def run(batches):
        for b in slices(batches):
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            found = [sketch(s) if len(s) else (np.zeros(0, np.int64), np.zeros(2, np.int64)) for s in sets]
            bits = np.array([x for _, x in found], np.int64).reshape(-1, 2)
            sims = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            columns = [pa.array(fps), pa.array(sims), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array([x for x, _ in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["id", "mark", "fp", "sim", "size", "low", "high", "bands"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), row_mark(text).alias("mark"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "id long, mark long, fp long, sim long, size long, low long, high long, bands array<long>")


def _sets(docs: DataFrame, by_fp: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(fp, shingles)`` of the documents that ``by_fp`` names, hashes as bytes."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["fp", "shingles"])

    left = docs.select(F.col(id_col).cast("long").alias("id"), row_mark(text).alias("mark"), F.col(text).alias("text"))
    by_fp = F.broadcast(by_fp) if by_fp.count() <= BROADCAST_ROWS else by_fp.hint("merge")
    joined = left.join(by_fp, left["id"].eqNullSafe(by_fp["win_id"]) & (left["mark"] == by_fp["win_mark"]))
    return joined.select("fp", "text").mapInArrow(run, "fp long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v, ...)`` that are similar."""
    names = pairs.columns

    def run(batches):
        for b in slices(batches):
            sides = (b.column(len(names) + i).to_pylist() for i in (0, 1))
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(*sides, strict=True)]
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b"))
    if pairs.count() <= BROADCAST_ROWS:  # only the sets that some pair needs are shuffled
        a = a.join(F.broadcast(pairs.select("u").distinct()), "u", "left_semi")
        b = b.join(F.broadcast(pairs.select("v").distinct()), "v", "left_semi")
    both = pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select(*names, "a", "b")
    return both.mapInArrow(run, pairs.schema)


def _possible(a: str, b: str):
    """Whether the sizes and sketches of two sets allow 0.8."""
    sizes = f"5 * least({a}.size, {b}.size) >= 4 * greatest({a}.size, {b}.size)"
    return F.expr(f"{sizes} AND bit_count({a}.low ^ {b}.low) + bit_count({a}.high ^ {b}.high) <= {128 - SAME}")


def _relabelled(rooted: DataFrame, merged: DataFrame) -> DataFrame:
    """``rooted(..., root)`` with the roots that ``merged(node, root)`` gives some of its roots."""
    new = merged.toDF("old_root", "new_root").hint("merge")
    joined = rooted.join(new, rooted["root"] == new["old_root"], "left")
    return joined.select(*(c for c in rooted.columns if c != "root"), F.coalesce("new_root", "root").alias("root"))


def _held(a: DataFrame, b: DataFrame, beside: str = "true", sketched: bool = True) -> DataFrame:
    """``(u, v, u_root, v_root)``: sets of one band in different components that may be similar."""
    beside = F.expr(beside) & _possible("a", "b") if sketched else F.expr(beside)
    met = a.alias("a").join(b.alias("b").hint("merge"), (F.col("a.h") == F.col("b.h")) & (F.col("a.root") != F.col("b.root")) & beside)
    first = F.col("a.fp") < F.col("b.fp")
    ordered = [F.when(first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")) for c in ("fp", "root")] + [F.when(first, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) for c in ("fp", "root")]
    return met.select(ordered[0].alias("u"), ordered[2].alias("v"), ordered[1].alias("u_root"), ordered[3].alias("v_root")).distinct()


def _by_grid(unique: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)``: sets with one SimHash, and sets whose SimHashes the grid links within two bits.

    Of sets with one SimHash the smallest stands for all, and of SimHashes around one word the
    smallest is linked to the others, so there are no more pairs than members and links.
    """
    from tessera.llm.simhash import links

    of = scratch.save(unique.groupBy("sim").agg(F.min("fp").alias("low_fp")), "sims")
    same = unique.join(of.hint("merge"), "sim").where("fp <> low_fp").select(F.col("fp").alias("u"), F.col("low_fp").alias("v"))
    found = scratch.save(links(of.select(F.col("sim").alias("fp")), scratch), "grid")
    around = found.join(found.groupBy("v").agg(F.min("u").alias("m")).hint("merge"), "v").where("u <> m").select("u", F.col("m").alias("v"))
    a, b = (of.select(F.col("sim").alias(x), F.col("low_fp").alias(f"{x}_fp")).hint("merge") for x in "uv")
    near = found.unionByName(around).distinct().join(a, "u").join(b, "v").select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v"))
    both = same.unionByName(near).where("u <> v")
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def classes(unique: DataFrame, sets_of, scratch: Scratch) -> DataFrame:
    """``(node, root)`` of the sets that are in a component of several; ``unique(fp, sim, size, low, high,
    bands)`` has each set once and ``sets_of`` gives the sets of some digests."""
    entries = unique.select("fp", F.posexplode("bands").alias("band", "h"))
    found = scratch.save(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "bands")
    info = unique.select("fp", "size", "low", "high")
    full = unique.select("fp", "size", "low", "high", F.posexplode("bands").alias("band", "h"))
    members = scratch.save(full.join(found.where("n > 2").select("h", "n").hint("merge"), "h"), "members_of_bands")
    few, hot = members.where(f"n <= {PAIR_UP}").drop("n", "band"), members.where(f"n > {PAIR_UP}").drop("n")
    two = found.where("n = 2").select("u", "v").unionByName(_by_grid(unique, scratch)).distinct()
    two = two.join(info.alias("a").hint("merge"), F.col("a.fp") == F.col("u")).join(info.alias("b").hint("merge"), F.col("b.fp") == F.col("v")).where(_possible("a", "b")).select("u", "v")
    more = few.alias("a").join(few.alias("b").hint("merge"), (F.col("a.h") == F.col("b.h")) & (F.col("a.fp") < F.col("b.fp")) & _possible("a", "b"))
    pairs = scratch.save(two.unionByName(more.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))).distinct(), "pairs")
    wanted = hot.select("fp").unionByName(pairs.select(F.col("u").alias("fp"))).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    sets = scratch.save(sets_of(wanted), "sets")
    roots = components(scratch.save(_verified(pairs, sets), "near"), scratch)
    if hot.isEmpty():
        return roots
    alone = hot.select(F.col("fp").alias("node")).distinct().join(roots.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("root"))
    labels = roots.unionByName(alone)
    sets_in = hot.groupBy("fp", "size", "low", "high").agg(F.collect_list(F.struct("band", "h")).alias("bands"))
    rooted = scratch.save(_relabelled(sets_in.withColumn("root", F.col("fp")), roots), "rooted")  # one row a set, whatever its bands
    for k, (low, high) in enumerate(ROUNDS):
        apart = scratch.save(_apart(_banded(rooted, low, high)), f"apart-{k}")
        pick = F.min(F.struct(F.xxhash64("fp").alias("x"), "fp", "size", "low", "high", "root")).alias("p")
        held = _held(apart, apart.groupBy("h").agg(pick).select("h", "p.fp", "p.size", "p.low", "p.high", "p.root"))
        merged = _merged(held, sets, scratch, str(k))
        if merged is not None:
            labels, rooted = _relabelled(labels, merged), scratch.save(_relabelled(rooted, merged), f"rooted-{k}")
    rest = _apart(_banded(rooted, 0, BANDS)).select("fp", "root").distinct()
    merged = _merged(_by_prefix(rest, sets, scratch), sets, scratch, "last")
    return scratch.save(labels if merged is None else _relabelled(labels, merged), "labels")


def _banded(rooted: DataFrame, low: int, high: int) -> DataFrame:
    """``rooted(fp, size, low, high, root, bands)`` with a row ``h`` for each of some of its bands."""
    some = F.explode(F.expr(f"filter(bands, x -> x.band >= {low} AND x.band < {high})")).alias("x")
    return rooted.select("fp", "size", "low", "high", "root", some).select("fp", "size", "low", "high", "root", F.col("x.h").alias("h"))


def _apart(rooted: DataFrame) -> DataFrame:
    """The rows of bands whose sets are in more than one component."""
    split = rooted.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
    return rooted.join(split.hint("merge"), "h")


def _merged(held: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """``(node, root)`` of the components that the similar ones of ``held(u, v, u_root, v_root)`` join."""
    near = scratch.save(_verified(scratch.save(held, f"held-{name}"), sets), f"near-{name}")
    return None if near.isEmpty() else components(near.select(F.col("u_root").alias("u"), F.col("v_root").alias("v")), scratch, f"cc-{name}")


def _by_prefix(rest: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v, u_root, v_root)``: all pairs of ``rest(fp, root)`` in different components that can be similar.

    Sets in one order of shingles, rarest first, that are similar at 0.8 share one of their first
    n - ceil(0.8 n) + 1, and from the first shingle that they share on each has enough left to reach
    0.8.  What many sets of the rest have in common comes last, so a group of sets that are alike
    but not similar meets late, where too little is left.  Of sets that meet, all shingles that no
    other set has are differences, and so is every bit in which the parities of the others' counts
    in 256 classes differ; similar sets have a ninth of their sizes in differences at most.
    """
    kept = scratch.save(rest.join(sets.hint("merge"), "fp"), "rest")

    def run(batches):
        for b in slices(batches):
            found = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], ["fp", "root", "s"])

    each = kept.select("fp", "root", "shingles").mapInArrow(run, "fp long, root long, s long")
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    parity = [F.expr(f"bit_xor(if(n > 1 AND (shiftright(s, 6) & 3) = {i}, shiftleft(1L, int(s & 63)), 0L))").alias(f"x{i}") for i in range(4)]
    ranked = each.join(often.hint("merge"), "s").groupBy("fp", "root").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("all"), F.expr("count_if(n = 1)").alias("own"), *parity)
    size = F.size("all")
    first = F.posexplode(F.slice("all", F.lit(1), size - F.ceil(size * 4 / 5).cast("int") + 1)).alias("at", "x")
    bits = [f"x{i}" for i in range(4)]
    posted = ranked.select("fp", "root", size.alias("size"), "own", *bits, first).where("x.n > 1").select("fp", "root", "size", "own", *bits, (F.col("size") - F.col("at")).alias("left"), F.col("x.s").alias("h"))
    posted = scratch.save(_apart(scratch.save(posted, "posted")), "posted-apart")
    differ = " + ".join(["a.own", "b.own", *(f"bit_count(a.{x} ^ b.{x})" for x in bits)])
    return _held(posted, posted, f"a.fp < b.fp AND 9 * least(a.left, b.left) >= 4 * (a.size + b.size) AND 9 * ({differ}) <= a.size + b.size", False)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component of similar ones stays (the smallest id, nulls last), with its columns.

    Null and blank texts have the empty set and are alike; a text of up to five words is one
    shingle.  Texts of any length are compared whole.  Of rows that repeat id and text one stays.
    Extra columns stay, whatever their names; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "near_copies")
    members = scratch.save(_sketches(docs, id_col, text), "members")
    by_fp = scratch.save(winners(members, ["fp"], "id", "mark"), "by_fp")
    unique = members.select("fp", "sim", "size", "low", "high", "bands")
    if by_fp.where("size > 1").count():
        unique = scratch.save(unique.dropDuplicates(["fp"]), "unique")

    def sets_of(wanted: DataFrame) -> DataFrame:
        named = scratch.save(by_fp.join(wanted.hint("merge"), "fp").select("fp", "win_id", "win_mark", "win_same"), "wanted")
        found = _sets(docs, named.drop("win_same"), id_col, text)
        return found if named.where("win_same > 1").isEmpty() else found.dropDuplicates(["fp"])

    roots = classes(unique, sets_of, scratch)
    rooted = by_fp.join(roots.hint("merge"), by_fp["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    order = F.struct(F.col("win_id").isNull().alias("no_id"), "win_id", "win_mark", "win_same")
    best = rooted.groupBy("root").agg(F.min(order).alias("b"))
    best = scratch.save(best.select("root", "b.win_id", "b.win_mark", "b.win_same"), "best")
    return keep_winners(docs, best, id_col, text)
