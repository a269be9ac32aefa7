"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens.  A queue earns credit in proportion to its weight
and the next token always comes from the queue that is furthest behind, so a window never differs
from the target mixture by more than a token per queue, and what a window owes a queue carries to
the next one.  In that order the token with index j of a queue of weight w has time (2j + 1) / 2w:
the first 4096 k tokens by (time, queue) fill windows 0 to k - 1.  How many of them a queue has is
computed in exact integers from k alone, so each partition knows every deficit at its start
without running through the windows before it.

Sources too rare to fill a place in every window share the last queue.  There documents are served
whole, each when its source is as far through its tokens as the others (or as far in tokens, where
the caller gives weights), so no source of the pool is ahead of another by more than a document.

A queue that runs out stops earning and the others share its credit, as in any work-conserving
scheduler.  Weights default to the sources' own token counts; then all queues end together.
Every window but the last is full.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, slices
from tessera.llm.tokens import encoder, vocabulary_file

LENGTH = 4096
#: Sources below one in so many tokens and without a weight of their own share the last queue, so that a window
#: has no more than so many queues beside those the caller weighs.
LEAST_SHARE = 1024
#: Rows of the table of queue positions up to which it is broadcast (about 40 bytes each).
BROADCAST_ROWS = 100_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Schedule:
    """How many tokens of each queue the first k windows hold, for any k."""

    def __init__(self, sizes: list[int], weights: list[int] | None = None, length: int = LENGTH) -> None:
        self.sizes, self.weights, self.length = sizes, weights or sizes, length
        self.total = sum(sizes)
        # phases: until the time sizes/weights of the next queue to run out
        order = sorted((q for q in range(len(sizes)) if sizes[q]), key=lambda q: (sizes[q] / self.weights[q], q))
        done, active = 0, sum(self.weights[q] for q in order)
        self._until: list[float] = []
        self._phase: list[tuple[int, int]] = []
        for q in order:
            self._until.append(done + active * sizes[q] / self.weights[q])
            self._phase.append((done, active))
            done, active = done + sizes[q], active - self.weights[q]
        self._seen: OrderedDict[int, list[int]] = OrderedDict()

    def _time(self, q: int, j: int) -> tuple[int, int]:
        return 2 * j + 1, 2 * self.weights[q]

    def filled(self, k: int) -> list[int]:
        """Tokens of each queue in the windows before ``k``."""
        if (found := self._seen.get(k)) is not None:
            return found
        want = min(k * self.length, self.total)
        if want == self.total:
            n = list(self.sizes)
        else:
            done, active = self._phase[min(bisect_right(self._until, want), len(self._phase) - 1)]
            over = want - done  # time is over / active
            n = [min(s, max(0, (2 * w * over + active) // (2 * active))) for s, w in zip(self.sizes, self.weights, strict=True)]
            gap = want - sum(n)
            while gap > 0:  # the earliest tokens that are left out
                q = self._first([q for q in range(len(n)) if n[q] < self.sizes[q]], n, 0)
                n[q], gap = n[q] + 1, gap - 1
            while gap < 0:  # the latest tokens that are in
                q = self._first([q for q in range(len(n)) if n[q] > 0], n, -1)
                n[q], gap = n[q] - 1, gap + 1
        self._seen[k] = n
        if len(self._seen) > 4096:
            self._seen.popitem(last=False)
        return n

    def _first(self, queues: list[int], n: list[int], at: int) -> int:
        """The queue whose token ``n + at`` is earliest (at 0) or latest (at -1)."""
        best = queues[0]
        for q in queues[1:]:
            (a, b), (c, d) = self._time(q, n[q] + at), self._time(best, n[best] + at)
            if a * d < c * b if at == 0 else a * d >= c * b:
                best = q
        return best

    def window_of(self, q: int, j: int) -> int:
        """The window that token ``j`` of queue ``q`` falls in."""
        k = int((j + 0.5) / self.sizes[q] * self.total) // self.length if self.weights is self.sizes else self._search(q, j)
        while k and self.filled(k)[q] > j:
            k -= 1
        while self.filled(k + 1)[q] <= j:
            k += 1
        return k

    def _search(self, q: int, j: int) -> int:
        lo, hi = 0, -(-self.total // self.length)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.filled(mid)[q] <= j else (lo, mid)
        return lo

    def pieces(self, q: int, j: int, n: int):
        """(start in the document, length, window, offset) of a document's n tokens from ``j`` on."""
        at, k = 0, self.window_of(q, j)
        while at < n:
            low, high = self.filled(k), self.filled(k + 1)
            take = min(n - at, high[q] - j - at)
            if take > 0:
                yield at, take, k, sum(high[:q]) - sum(low[:q]) + j + at - low[q]
                at += take
            k += 1


def _tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text: str, source: str) -> DataFrame:
    """``(id, source, part, before, n, ids)``: ids as two or four bytes each, the end id included;
    ``before``: tokens of the same source earlier in the same partition."""

    def run(batches):
        coder, part, before = encoder(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], coder.kind).tobytes()
        for b in batches:
            for a in range(0, b.num_rows, 256):
                some = b.slice(a, 256)
                coded = [x.tobytes() + end for x in coder.encode(some.column(2).to_pylist())]
                n = [len(x) // coder.kind.itemsize for x in coded]
                first = []
                for s, m in zip(some.column(1).to_pylist(), n, strict=True):
                    first.append(before.get(s, 0))
                    before[s] = first[-1] + m
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([part] * len(n), pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(coded, pa.binary())], ["id", "source", "part", "before", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, source string, part long, before long, n long, ids binary")


def _pool(docs: DataFrame, equal: bool, scratch: Scratch) -> DataFrame:
    """``(p_source, p_part, p_before, j)`` of ``docs(source, part, before, pos, size, n)``: the tokens
    before a document in the queue that its source shares with others.

    A range sort of a row per document; the running sum is made within partitions, whose totals are
    a row each.
    """
    middle = F.col("pos") + F.col("n") / 2
    turn = docs.select("source", "part", "before", "n", "pos", (middle if equal else middle / F.col("size")).alias("turn"))
    order = ["turn", "source", "pos"]

    def run(batches):
        pid, ahead = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(3).to_numpy()
            first = ahead + np.cumsum(n) - n
            ahead += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.full(len(n), pid)), pa.array(first), b.column(3)], ["p_source", "p_part", "p_before", "pid", "first", "n"])

    placed = scratch.save(turn.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "p_source string, p_part long, p_before long, pid long, first long, n long"), "pool")
    totals = placed.groupBy(F.col("pid").alias("t_pid")).agg(F.sum("n").alias("n"))
    offsets = totals.select("t_pid", F.coalesce(F.sum("n").over(Window.orderBy("t_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), F.col("pid") == F.col("t_pid")).select("p_source", "p_part", "p_before", (F.col("first") + F.col("offset")).alias("j"))


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, length: int = LENGTH, weights: dict[str | None, int] | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece, columns as in ``PIECES`` (the id under its own name).

    ``weights`` (positive integers by source; others weigh 1) sets the mixture; by default a source
    weighs its tokens.  A source with a weight always has a queue of its own; those that share the
    last queue weigh together what they weigh alone.  A null source is a source; null and empty
    texts are their end id alone; a document longer than a sequence is cut, whole texts are packed;
    repeated rows and ids are documents of their own; extra columns are ignored, whatever their
    names; no rows give no pieces.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or vocabulary_file("word_bpe_49k.json")
    scratch = Scratch(spark, "packing")
    tokens = scratch.save(_tokens(docs, tokenizer, end_id, id_col, text, source), "tokens")
    width = 2 if encoder(tokenizer).kind.itemsize == 2 else 4
    parts = scratch.save(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "parts")
    sums = parts.groupBy("source").agg(F.sum("n").alias("n"))
    total, sources = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))).first()
    # at most LEAST_SHARE rows and one for each weight
    alone = F.col("n") * LEAST_SHARE >= total
    if weights:
        alone = alone | F.col("source").isin([s for s in weights if s is not None]) & F.col("source").isNotNull()
        alone = alone | F.col("source").isNull() if None in weights else alone
    large = sorted((r.source is not None, r.source or "", r.source, r.n) for r in sums.where(alone).collect())
    sizes = [n for *_, n in large]
    own = [s for *_, s, _ in large]
    rest = total - sum(sizes)
    queue = spark.createDataFrame([(s, q) for q, s in enumerate(own)], "name string, own_queue int")
    chosen = [weights.get(s, 1) for s in own] + [sources - len(own)] * (rest > 0) if weights else None
    sizes += [rest] * (rest > 0)
    last = len(own)
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.select("source", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    named = based.join(F.broadcast(queue), based["source"].eqNullSafe(queue["name"]), "left")
    bases = scratch.save(named.select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), F.coalesce("own_queue", F.lit(last)).alias("queue"), "base"), "bases")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases.hint("merge")
    placed = tokens.join(bases, (tokens["part"] == bases["b_part"]) & tokens["source"].eqNullSafe(bases["b_source"]))
    placed = placed.withColumn("j", F.col("base") + F.col("before"))
    if rest:
        pooled = placed.where(F.col("queue") == last)
        totals = sums.select(F.col("source").alias("s_source"), F.col("n").alias("size")).hint("merge")
        turns = pooled.select("source", "part", "before", F.col("j").alias("pos"), "n").join(totals, F.col("source").eqNullSafe(F.col("s_source")))
        turn = _pool(turns, bool(weights), scratch).hint("merge")
        same = (F.col("part") == F.col("p_part")) & (F.col("before") == F.col("p_before")) & F.col("source").eqNullSafe(F.col("p_source"))
        shared = pooled.drop("j").join(turn, same)
        placed = placed.where(F.col("queue") != last).select("id", "queue", "j", "n", "ids").unionByName(shared.select("id", "queue", "j", "n", "ids"))

    names = [id_col, *(x.split()[0] for x in PIECES.split(", ")[1:])]

    def run(batches):
        plan, kind = Schedule(sizes, chosen, length), np.dtype(f"<u{width}")
        for b in slices(batches):
            rows: list[tuple] = []
            for doc_id, q, j, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                wide = np.frombuffer(raw, kind).astype("<u4").view(np.uint8)
                rows += [(doc_id, at, take, zlib.crc32(wide[4 * at : 4 * (at + take)]), n, k, off) for at, take, k, off in plan.pieces(q, j, n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return placed.select("id", "queue", "j", "n", "ids").mapInArrow(run, PIECES.replace("doc_id", f"`{id_col}`"))
