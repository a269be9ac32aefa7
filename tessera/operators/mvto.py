"""Multiversion timestamp ordering: questions about version logs, and a store that runs schedules.

A transaction's number is its timestamp.  Reads see the latest version whose writer isn't later
than the reader; a write is refused when a later transaction has read the version it would follow.
The questions are relational and scale with the log; a schedule is by nature an ordered fold, run
in the store, one shard of keys and transactions apart from the next.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import as_of
from tessera.sources.shared import Shared

#: Timestamps of a block of the as-of join.
BLOCK = 4_096
#: Edges that a round of a cascade follows, and rounds after which its tables become one.
HOPS, FOLD = 4, 4


def asof_reads(reads: DataFrame, versions: DataFrame, block: int = BLOCK) -> DataFrame:
    """``reads(id, xact, key)`` with ``wts, value`` of the version each sees (null: none).

    ``versions(key, wts, value)`` has one row for each key and wts.
    """
    found = as_of(reads.withColumn("seq", F.col("xact").cast("bigint")), versions, block)
    return found.drop("seq")


def read_timestamps(reads: DataFrame, versions: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(key, wts, rts)``: the latest reader of each version, its writer if none is later."""
    seen = asof_reads(reads, versions, block).where("wts IS NOT NULL").groupBy("key", "wts").agg(F.max("xact").alias("reader"))
    joined = versions.select("key", "wts").join(seen, ["key", "wts"], "left")
    return joined.select("key", "wts", F.greatest("wts", F.coalesce("reader", "wts")).alias("rts"))


def write_conflicts(writes: DataFrame, reads: DataFrame, versions: DataFrame, block: int = BLOCK) -> DataFrame:
    """``writes(id, xact, key)`` that are refused: the version they follow was read by a later one."""
    stamped = read_timestamps(reads, versions, block).withColumnRenamed("rts", "value")
    seen = asof_reads(writes, stamped, block)
    return seen.where("value > xact").select(*writes.columns, "wts", F.col("value").alias("rts"))


def reads_from(reads: DataFrame, versions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ``(reader, writer)``, a transaction's own versions left out."""
    seen = asof_reads(reads, versions, block).where("wts IS NOT NULL AND wts <> xact")
    return seen.select(F.col("xact").alias("reader"), F.col("wts").alias("writer")).distinct()


def cascade(edges: DataFrame, aborted: DataFrame) -> DataFrame:
    """``(xact)``: aborted transactions and all that read from them, directly or through others.

    Readers are later than their writers, so the frontier runs dry.  A round follows ``HOPS`` edges
    from the frontier; what it adds is a written table, and all that is found is folded into one
    table every ``FOLD`` rounds.
    """
    shared = Shared(edges.sparkSession, "cascade")
    edges = shared.save(edges, "edges")
    frontier = shared.save(aborted.select(F.col("xact")).distinct(), "f0")
    done, k = frontier, 0
    while not frontier.isEmpty():
        k += 1
        near, hits = frontier, []
        for _ in range(HOPS):
            near = edges.join(near, edges["writer"] == near["xact"], "left_semi").select(F.col("reader").alias("xact")).distinct()
            hits.append(near)
        frontier = shared.save(reduce(DataFrame.unionByName, hits).distinct().join(done, "xact", "left_anti"), f"f{k}")
        done = done.unionByName(frontier)
        if k % FOLD == 0:
            done = shared.save(done, f"done-{k}")
    return done


def live_versions(versions: DataFrame, dead: DataFrame) -> DataFrame:
    """The versions whose writer isn't dead."""
    return versions.join(dead.select(F.col("xact").alias("wts")), "wts", "left_anti").select(*versions.columns)


class Refused(Exception):
    """An operation the protocol or the store's rules don't allow."""


class Store:
    """One shard's data under multiversion timestamp ordering."""

    def __init__(self) -> None:
        self.last = 0
        self.status: dict[int, str] = {}  # active, pending, committed, aborted
        self.data: dict[int, dict[int, list[int]]] = {}  # key -> writer -> [value, latest reader]
        self.wrote: dict[int, set[int]] = defaultdict(set)  # writer -> keys it has versions of
        self.waits: dict[int, set[int]] = defaultdict(set)  # reader -> writers it depends on
        self.feeds: dict[int, set[int]] = defaultdict(set)  # writer -> its readers

    def begin(self, xact: int | None = None) -> int:
        """Start a transaction: the next timestamp, or a given later one."""
        xact = self.last + 1 if xact is None else xact
        if xact <= self.last:
            raise Refused(f"timestamp {xact} isn't later than {self.last}")
        self.last, self.status[xact] = xact, "active"
        return xact

    def _active(self, xact: int) -> None:
        if self.status.get(xact) != "active":
            raise Refused(f"transaction {xact} isn't active")

    def _fail(self, xact: int, why: str):
        self._undo(xact)
        raise Refused(why)

    def _visible(self, xact: int, key: int) -> int:
        seen = [w for w in self.data.get(key, ()) if w <= xact]
        if not seen:
            self._fail(xact, f"transaction {xact} sees no key {key}")
        return max(seen)

    def insert(self, xact: int, key: int, value: int) -> None:
        self._active(xact)
        if self.data.get(key):
            self._fail(xact, f"key {key} is there already")
        self.data[key] = {xact: [value, xact]}
        self.wrote[xact].add(key)

    def read(self, xact: int, key: int) -> int:
        self._active(xact)
        writer = self._visible(xact, key)
        version = self.data[key][writer]
        version[1] = max(version[1], xact)
        if writer != xact and self.status.get(writer) in ("active", "pending"):
            self.waits[xact].add(writer)
            self.feeds[writer].add(xact)
        return version[0]

    def write(self, xact: int, key: int, value: int) -> None:
        self._active(xact)
        writer = self._visible(xact, key)
        if self.data[key][writer][1] > xact:
            self._fail(xact, f"transaction {xact} writes key {key} after a later read")
        if writer == xact:
            self.data[key][xact][0] = value
        else:
            self.data[key][xact] = [value, xact]
            self.wrote[xact].add(key)

    def commit(self, xact: int) -> str:
        """Committed, or pending until all that it read from have committed."""
        self._active(xact)
        self.status[xact] = "pending"
        ready = [xact] if not self.waits[xact] else []
        while ready:
            done = ready.pop()
            self.status[done] = "committed"
            for reader in self.feeds.pop(done, ()):
                self.waits[reader].discard(done)
                if self.status[reader] == "pending" and not self.waits[reader]:
                    ready.append(reader)
        return self.status[xact]

    def rollback(self, xact: int) -> list[int]:
        """Abort an active or pending transaction; returns it and all that fell with it."""
        if self.status.get(xact) not in ("active", "pending"):
            raise Refused(f"transaction {xact} can't be rolled back")
        return self._undo(xact)

    def _undo(self, xact: int) -> list[int]:
        todo, gone = [xact], []
        while todo:
            x = todo.pop()
            if self.status.get(x) not in ("active", "pending"):
                continue
            self.status[x] = "aborted"
            gone.append(x)
            todo += self.feeds.pop(x, ())
            for writer in self.waits.pop(x, ()):
                self.feeds[writer].discard(x)
            for key in self.wrote.pop(x, ()):
                del self.data[key][x]
                if not self.data[key]:
                    del self.data[key]
        return sorted(gone)


RESULT = "shard long, seq long, xact long, op string, key long, outcome string, value long, final string"


def replay(log: DataFrame) -> DataFrame:
    """Run ``log(shard, seq, xact, op, key, value)`` in seq order, each shard in a store of its own.

    Every operation returns a row: ``outcome`` ok or refused, the value read, and the final status
    of its transaction.  A shard's log is folded in one task, since each step depends on all before.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        store, out = Store(), []
        for r in rows.sort_values("seq").itertuples():
            value, outcome = None, "ok"
            try:
                if r.op == "begin":
                    store.begin(int(r.xact))
                elif r.op == "read":
                    value = store.read(int(r.xact), int(r.key))
                elif r.op in ("insert", "write"):
                    getattr(store, r.op)(int(r.xact), int(r.key), int(r.value))
                elif r.op in ("commit", "rollback"):
                    getattr(store, r.op)(int(r.xact))
                else:
                    raise Refused(f"no operation {r.op}")
            except Refused:
                outcome = "refused"
            out.append((r.shard, r.seq, r.xact, r.op, r.key, outcome, value))
        found = pd.DataFrame(out, columns=["shard", "seq", "xact", "op", "key", "outcome", "value"])
        found["value"] = found["value"].astype("Int64")
        found["final"] = [store.status.get(int(x)) for x in found["xact"]]
        return found

    return log.groupBy("shard").applyInPandas(run, RESULT)
