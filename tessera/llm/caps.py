"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector falls into every filter whose cap it lies in.  The directions
are a structured random product code: the space is rotated, cut into blocks, each block has its
own random code, and a filter is one code word of each block.  So there may be very many filters,
and a vector's are found by list decoding: partial sums that can't reach the cap any more are
dropped block by block.  Vectors meet in their common filters and every pair that meets is
verified in double precision.

Cap height, number of filters and filters a vector are computed from the number of vectors so
that a filter holds ``OCCUPANCY`` vectors on average at every size and a pair at the threshold
shares ``SHARED`` filters on average (so that it is missed with a chance of a few in a thousand).

Equal vectors are one class with a multiplicity.  A filter with many vectors is cut into tiles of
bounded size.  A tile returns, for each vector, how many links it has there that no smaller common
filter counts, and one link to the smallest vector of its component there: pairs are never emitted.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.scratch import Scratch

COSINE = 0.9
OCCUPANCY, SHARED, CODES, TILE = 128, 8.0, 16, 512
SEED = 20
#: Rows of the table of large filters up to which it is broadcast.
BROADCAST_ROWS = 50_000


def _tail(height, dim: int):
    """Share of the unit sphere beyond ``height`` along one axis."""
    x = np.linspace(-1, 1, 20_001)
    density = np.clip(1 - x * x, 0, None) ** ((max(4, dim) - 3) / 2)
    below = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return np.interp(height, x, 1 - below / below[-1])


def _both(height: float, cosine: float, dim: int) -> float:
    """Chance that a neighbour at ``cosine`` lies in a cap that a vector lies in."""
    x = np.linspace(height, 1, 4_001)[:-1]
    density = (1 - x * x) ** ((max(4, dim) - 3) / 2)
    side = (height - cosine * x) / (math.sqrt(1 - cosine * cosine) * np.sqrt(1 - x * x))
    return float((density * _tail(np.clip(side, -1, 1), dim - 1)).sum() / density.sum())


class Filters:
    """The filters for ``n`` vectors of one dimension: ``CODES`` independent product codes.

    Filters of one code are alike, so a vector may fall into none of them; it rarely does in all.
    """

    def __init__(self, n: int, dim: int, cosine: float = COSINE, shared: float = SHARED, occupancy: int = OCCUPANCY, codes: int = CODES) -> None:
        share = min(0.05, occupancy / max(1, n))
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if _tail(mid, dim) > share else (low, mid)
        self.height = low
        self.lists = shared / _both(low, cosine, dim)  # filters a vector, on average
        count = self.lists / share / codes  # filters of a code
        self.blocks = min(dim, 2 if count <= 1 << 16 else 3 if count <= 1 << 24 else 4)
        self.words = max(2, math.ceil(count ** (1 / self.blocks)))
        rng = np.random.default_rng((SEED, dim))
        self.parts = np.array_split(np.arange(dim), self.blocks)
        self.codes = []
        for _ in range(codes):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            words = [rng.standard_normal((self.words, len(p))) for p in self.parts]
            # so long that a whole filter is a unit vector
            words = [(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt(c.shape[1] / dim)).T for c in words]
            self.codes.append((turn, words))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``unit`` and the filters they fall into, by row and filter."""
        found = [self._decode(unit, turn, words) for turn, words in self.codes]
        rows = np.concatenate([r for r, _ in found])
        names = np.concatenate([c * self.words**self.blocks + f for c, (_, f) in enumerate(found)])
        order = np.lexsort((names, rows))
        return rows[order], names[order]

    def _decode(self, unit: np.ndarray, turn: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ turn
        scores = [turned[:, p] @ c for p, c in zip(self.parts, words, strict=True)]
        rest = np.zeros((len(scores) + 1, len(unit)))
        for b in reversed(range(len(scores))):
            rest[b] = rest[b + 1] + scores[b].max(axis=1, initial=-np.inf)
        rows, names, sums = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for b, s in enumerate(scores):
            reach = sums[:, None] + s[rows]
            at, word = np.nonzero(reach + rest[b + 1][rows][:, None] >= self.height)
            sums, names, rows = reach[at, word], names[at] * self.words + word, rows[at]
        return rows, names


@lru_cache(maxsize=8)
def filters(n: int, dim: int) -> Filters:
    return Filters(n, dim)


def _units(raw: list[bytes], kind: str, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each position of a symmetric matrix with a true diagonal."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _tile(name: int, left: int, right: int, kind: str, cids: np.ndarray, mult: np.ndarray, chunk: np.ndarray, raw: list[bytes], lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cid, links, root cid) of the vectors of one tile with a link in it."""
    order = np.argsort(cids, kind="stable")
    unit = _units([raw[i] for i in order], kind, len(raw[0]) // np.dtype(kind).itemsize)
    cids, mult, chunk = cids[order], mult[order], chunk[order]
    linked = unit @ unit.T >= COSINE
    np.fill_diagonal(linked, True)
    some = np.flatnonzero(linked.sum(axis=1) > 1)
    if len(some) == 0:
        return cids[:0], mult[:0], cids[:0]
    linked, cids, mult, chunk = linked[np.ix_(some, some)], cids[some], mult[some], chunk[some]
    counted = linked.copy()
    np.fill_diagonal(counted, False)
    if left != right:
        counted &= chunk[:, None] != chunk[None, :]
    smaller = [f[f < name] for f in (lists[order[i]] for i in some)]
    used = np.unique(np.concatenate(smaller))
    if len(used):
        held = np.zeros((len(some), len(used)), np.float32)
        for i, f in enumerate(smaller):
            held[i, np.searchsorted(used, f)] = 1
        counted &= held @ held.T == 0
    return cids, counted @ mult, cids[_roots(linked)]


def _usable(vec: str):
    """Whether a vector can link: not empty or zero, all components finite."""
    finite = f"forall(`{vec}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    return F.coalesce(F.expr(f"size(`{vec}`) > 0 AND {finite} AND exists(`{vec}`, x -> x <> 0)"), F.lit(False))


def classes(vectors: DataFrame, scratch: Scratch, id_col: str, vec: str) -> DataFrame:
    """A written table with a row for each distinct usable vector: ``cid, h1, h2, low, mult, raw``."""
    rows = vectors.where(_usable(vec)).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    grouped = rows.groupBy(F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v"))
    kind = "<f4" if "float" in vectors.schema[vec].dataType.simpleString() else "<f8"

    def flat(batches):
        for b in batches:
            raw = [np.array(v, kind).tobytes() for v in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(raw, pa.binary())], ["h1", "h2", "low", "mult", "raw"])

    flatted = grouped.mapInArrow(flat, "h1 long, h2 int, low long, mult long, raw binary")
    return scratch.save(flatted.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")


def _filtered(table: DataFrame, n: int, kind: str, whole: bool) -> DataFrame:
    """``(filter, chunk hash)`` of every vector's filters, with the vector and its list if ``whole``."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 512):
                cids, mult, raw = (b.column(c).slice(a, 512) for c in range(3))
                vectors = raw.to_pylist()
                sizes = np.array([len(v) for v in vectors])
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    dim = int(size) // np.dtype(kind).itemsize
                    rows, names = filters(n, dim).decode(_units([vectors[i] for i in at], kind, dim))
                    names += dim << 48
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(names)], ["filter"])
                        continue
                    lists = np.split(names, np.searchsorted(rows, np.arange(1, len(at))))
                    back = pa.array(at[rows])
                    own = pa.array([x.tobytes() for x in lists], pa.binary()).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(names), cids.take(back), mult.take(back), raw.take(back), own], ["filter", "cid", "mult", "raw", "list"])

    chosen = table.select("cid", "mult", "raw")
    return chosen.mapInArrow(run, "filter long, cid long, mult long, raw binary, list binary" if whole else "filter long")


def link_counts(table: DataFrame, kind: str) -> DataFrame:
    """``(cid, links, root)`` rows of all tiles; a class's links are the sum."""
    n = table.count()
    sizes = _filtered(table, n, kind, False).groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    large = sizes.select(F.col("filter").alias("l_filter"), F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large.hint("merge")
    rows = _filtered(table, n, kind, True)
    rows = rows.join(large, rows["filter"] == large["l_filter"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("filter", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "cid", "mult", "raw", "list")

    def run(key, data):
        name, left, right = (k.as_py() for k in key)
        cids, mult, chunk = (data.column(c).to_numpy() for c in ("cid", "mult", "chunk"))
        if len(cids) < 2:
            out = (cids[:0],) * 3
        else:
            out = _tile(name, left, right, kind, cids, mult, chunk, data.column("raw").to_pylist(), [np.frombuffer(x, np.int64) for x in data.column("list").to_pylist()])
        return pa.table({"cid": pa.array(out[0], pa.int64()), "links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.int64())})

    return rows.groupBy("filter", "a", "b").applyInArrow(run, "cid long, links long, root long")


def annotate(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Null and zero vectors and those with null or non-finite components link with nothing, nor do
    vectors of different dimension with each other; such a row is its own component.  Rows with a
    null id count as links but are never a component's id.  Labels and other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "caps")
    table = classes(vectors, scratch, id_col, vec)
    kind = "<f4" if "float" in vectors.schema[vec].dataType.simpleString() else "<f8"
    found = scratch.save(link_counts(table, kind), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links")).withColumnRenamed("cid", "k_cid")
    roots = components(found.where("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")), scratch)
    named = table.select("cid", "h1", "h2", "low", "mult").join(roots, F.col("cid") == F.col("node"), "left").withColumn("top", F.coalesce("root", "cid"))
    named = named.join(links, F.col("cid") == F.col("k_cid"), "left")
    named = scratch.save(named.select("h1", "h2", "low", "top", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n")), "named")
    lowest = scratch.save(named.groupBy(F.col("top").alias("l_top")).agg(F.min("low").alias("component")), "lowest")
    named = scratch.save(named.join(lowest.hint("merge"), F.col("top") == F.col("l_top")).select("h1", "h2", "n", "component"), "classes_named")
    rows = vectors.select(F.col(id_col).alias("id"), F.when(_usable(vec), F.xxhash64(vec)).alias("v1"), F.hash(vec).alias("v2"))
    joined = rows.join(named.hint("merge"), (F.col("v1") == F.col("h1")) & (F.col("v2") == F.col("h2")), "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
