"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments of four bits and mapped to its vector of 16 bit
counts.  The Manhattan distance of two such vectors never exceeds the fingerprints' Hamming
distance, so fingerprints within two bits lie within two in the grid of count vectors.  Each
fingerprint is entered in its own grid cell and in the cells one step away; whenever two vectors
lie within two steps, some cell holds both.  Candidates of a cell are verified on the bits.

Where there are very many fingerprints a cell has many by chance.  Such a cell is cut further: two
fingerprints within two bits agree in one of ``THIRDS``, so members meet by cell and third, and are
verified there.  Only groups that are truly dense, of more than ``PAIR_UP`` that share a cell and a
third, aren't paired up: their members are linked to the 64 words one bit away.  Two fingerprints
within two bits share such a word and a shared word proves two bits at most, so the components are
the same, with links linear in the members.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import near_copies
from tessera.llm.components import components
from tessera.llm.scratch import Scratch, keep_winners, row_mark, slices, winners

SHINGLE = 3
MAX_BITS = 2
#: Cells with more fingerprints are cut by their thirds; thirds with more link them through words one bit away.
PAIR_UP = 16
THIRDS = ((1 << 22) - 1, (1 << 43) - (1 << 22), -1 << 43)  # the last as a signed number
_SLICE = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats included; no words: 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(words) - size + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; of none: 0."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _SLICE):
        bits = np.unpackbits(hashes[a : a + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(id, mark, fp)``: a document's fingerprint as a signed 64-bit integer."""

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, size) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "mark", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), row_mark(text).alias("mark"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "id long, mark long, fp long")


def _cells(fps: DataFrame) -> DataFrame:
    """``(cell, fp)``: a fingerprint's grid cell (16 counts of three bits each) and those next to it."""
    counts = F.expr("transform(sequence(0, 15), i -> bit_count(shiftright(fp, 4 * i) & 15))")
    cell = F.expr("aggregate(sequence(0, 15), 0L, (a, i) -> a | shiftleft(bigint(n[i]), 3 * i))")
    up = "transform(filter(sequence(0, 15), i -> n[i] < 4), i -> c + shiftleft(1L, 3 * i))"
    down = "transform(filter(sequence(0, 15), i -> n[i] > 0), i -> c - shiftleft(1L, 3 * i))"
    return fps.select("fp", counts.alias("n")).select("fp", "n", cell.alias("c")).select(F.explode(F.expr(f"concat(array(c), {up}, {down})")).alias("cell"), "fp")


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)`` whose components are those of all pairs of ``fps(fp)`` (distinct) within two bits."""
    near = F.expr(f"bit_count(u ^ v) <= {MAX_BITS}")
    found = scratch.save(_cells(fps).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "cells")
    out = found.where("n = 2").where(near).select("u", "v").distinct()
    more = found.where("n > 2").select("cell", "n")
    if not more.isEmpty():
        members = scratch.save(_cells(fps).join(more.hint("merge"), "cell"), "cell_members")
        out = out.unionByName(_paired(members.where(f"n <= {PAIR_UP}"), ["cell"]))
        if not more.where(f"n > {PAIR_UP}").isEmpty():
            out = out.unionByName(_thirds(members.where(f"n > {PAIR_UP}").select("cell", "fp"), scratch))
    return out


def _paired(members: DataFrame, group: list[str]) -> DataFrame:
    """Pairs ``(u, v)`` of a group's members that are within two bits."""
    a, b = members.select(*group, F.col("fp").alias("u")), members.select(*group, F.col("fp").alias("v"))
    return a.join(b.hint("merge"), group).where("u < v").where(F.expr(f"bit_count(u ^ v) <= {MAX_BITS}")).select("u", "v")


def _thirds(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of cells with many ``members(cell, fp)``."""
    third = F.explode(F.array(*(F.struct(F.lit(i).alias("third"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(THIRDS))))
    group = ["cell", "third", "bits"]
    cut = members.select("cell", "fp", third.alias("t")).select("cell", "t.third", "t.bits", "fp")
    sizes = cut.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = scratch.save(cut.join(sizes.hint("merge"), group), "thirds")
    dense = cut.where(f"n > {PAIR_UP}").select(F.col("fp").alias("u")).distinct()
    ball = F.explode(F.expr("transform(sequence(0, 63), i -> u ^ shiftleft(1L, i))"))
    return _paired(cut.where(f"n <= {PAIR_UP}"), group).distinct().unionByName(dense.select("u", ball.alias("v")))


def group(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables ``members(id, mark, fp)`` and ``classes(fp, low, root)``: of each fingerprint the
    smallest document id (nulls last) and its component's representative fingerprint."""
    members = scratch.save(fingerprints(docs, id_col, text), "members")
    fps = scratch.save(members.groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    roots = components(links(fps.select("fp"), scratch), scratch)
    joined = fps.join(roots.hint("merge"), fps["fp"] == roots["node"], "left")
    return members, scratch.save(joined.select("fp", "low", F.coalesce("root", "fp").alias("root")), "classes")


def annotate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    A null or blank text has fingerprint zero and links like any other.  A component without any id
    has a null ``component_id``.  Repeated rows stay; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    members, classes = group(docs, scratch, id_col, text)
    lowest = scratch.save(classes.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = scratch.save(classes.join(lowest.hint("merge"), "root").select("fp", "component_id"), "named")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return members.join(named.hint("merge"), "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """One document of each component stays (the smallest id, nulls last), with the columns it came with.

    Without ``similarity`` documents link as in ``annotate``.  With 0.8 they link at a Jaccard
    similarity of 0.8 or more of their sets of five-word shingles.  Candidates are those that this
    module's grid links and, since 64 bits are too short to find all, those of min-wise bands; all
    are verified exactly (see ``near_copies``).  A null
    or blank text is like any other such; of rows that repeat id and text one stays; extra columns
    stay, whatever their names; no rows give no rows.
    """
    if similarity is not None:
        if similarity != near_copies.SIMILARITY:
            raise ValueError(f"near copies are those at {near_copies.SIMILARITY}")
        return near_copies.deduplicate(docs, id_col, text)
    scratch = Scratch(docs.sparkSession, "simhash")
    members, classes = group(docs, scratch, id_col, text)
    by_fp = winners(members, ["fp"], "id", "mark")
    order = F.struct(F.col("win_id").isNull().alias("no_id"), "win_id", "win_mark", "win_same")
    best = classes.join(by_fp, "fp").groupBy("root").agg(F.min(order).alias("b"))
    best = scratch.save(best.select("root", "b.win_id", "b.win_mark", "b.win_same"), "best")
    return keep_winners(docs, best, id_col, text)
