"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text.  A batch is
reduced to one row per digest first; a sort-merge anti-join against the index leaves the new
digests, which are appended.  The index side needs no shuffle, and both sides hold each digest
once, so no copy count can skew that join.

A folder holds an index: ``state.json`` (number of buckets, current version, appends since the last
compaction) and the rows of each version in a folder of its own.  Rows name the batch that added
them.  A batch that is run again, after a failure or by mistake, isn't held against its own rows
and adds only those that are missing, so it keeps the same documents.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, keep_winners, row_mark, winners

#: Runs of white space count as one space.
SPACE = r"[\x20\x09-\x0D]+"


def digest(text: str):
    """SHA-256 (binary) of the text, a null being empty, with each run of white space one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "), 256))


class DigestIndex:
    """Digests seen so far with the document that stays: ``(digest, keep_id, batch)``, a row each.

    One writer at a time.  Also a context manager, which closes the index at the end.
    """

    #: Appends after which the files of a bucket are merged into one, sorted again.
    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        """Open the index at ``path`` (a folder all executors reach) or start an empty one.

        ``buckets`` is the number a new index is started with (by default the session's number of
        shuffle partitions); an index that exists keeps its own, and asking for another one raises.
        """
        self.spark, self.path, self.table = spark, path.rstrip("/"), None
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._file = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state.json")
        self._fs = self._file.getFileSystem(conf)
        if self._fs.exists(self._file):
            self._state = json.loads("\n".join(r.value for r in spark.read.text(str(self._file.toString())).collect()))
            if buckets is not None and int(buckets) != self._state["buckets"]:
                raise ValueError(f"the index at {path} has {self._state['buckets']} buckets, not {buckets}")
        else:
            self._state = {"buckets": int(buckets or spark.conf.get("spark.sql.shuffle.partitions")), "version": 0, "appends": 0}
            self._write_state()
        self.buckets = self._state["buckets"]
        self._open()

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _write_state(self) -> None:
        """Replace the state file: written beside it, then renamed."""
        beside = self._file.suffix(f"-{uuid.uuid4().hex}")
        out = self._fs.create(beside)
        out.write(bytearray(json.dumps(self._state).encode()))
        out.close()
        self._fs.delete(self._file, False)
        self._fs.rename(beside, self._file)

    def _create(self, version: int) -> str:
        table = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self._state['buckets']} BUCKETS LOCATION '{self.path}/v{version}'"
        )
        return table

    def _open(self) -> None:
        self.close()
        self.table = self._create(self._state["version"])

    def close(self) -> None:
        """Remove the table's entry from the session's catalog; the files stay."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.table = None

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, batch: DataFrame, name: str = "") -> DataFrame:
        """The rows of ``batch`` (one per digest) whose digest no other batch than ``name`` has added."""
        return batch.join(self.rows().where(F.col("batch") != name).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame, name: str = "") -> None:
        """Add the rows ``(digest, keep_id)`` that the index lacks: one sorted file per bucket."""
        lacking = fresh.select("digest", "keep_id").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._by_bucket(lacking.select("digest", "keep_id", F.lit(name).alias("batch"))).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        self._state["appends"] += 1
        self._write_state()
        if self._state["appends"] >= self.COMPACT:
            self.compact()

    def _by_bucket(self, rows: DataFrame) -> DataFrame:
        """Each bucket's rows in one partition, by an expression that isn't optimised away for being the bucketing."""
        return rows.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))

    def compact(self) -> None:
        """Merge each bucket's files into one.  The new version counts once the state names it."""
        old, version = self._state["version"], self._state["version"] + 1
        folder = self._file.getParent().suffix(f"/v{version}")
        self._fs.delete(folder, True)  # of an attempt that failed
        table = self._create(version)
        self._by_bucket(self.rows()).write.insertInto(table)
        self.spark.sql(f"DROP TABLE {table}")
        self._state |= {"version": version, "appends": 0}
        self._write_state()
        self._open()
        self._fs.delete(self._file.getParent().suffix(f"/v{old}"), True)


def resolve(docs: DataFrame, index: DigestIndex, scratch: Scratch, id_col: str = "doc_id", text: str = "text", batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Deduplicate a batch against the index and append what is new.

    Returns two written tables: the batch's members ``(id, digest, mark)`` and its groups
    ``(digest, win_id, win_mark, win_same, size, keep_id, is_new)``.
    """
    batch = batch or uuid.uuid4().hex
    members = scratch.save(docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), row_mark(text).alias("mark")), "members")
    groups = scratch.save(winners(members, ["digest"], "id", "mark"), "groups")
    fresh = index.unseen(groups, batch).select("*", F.col("win_id").alias("keep_id"), F.lit(True).alias("is_new"))
    known = groups.join(index.rows().where(F.col("batch") != batch).select("digest", "keep_id").hint("merge"), "digest").select(*groups.columns, "keep_id", F.lit(False).alias("is_new"))
    groups = scratch.save(fresh.unionByName(known), "resolved")
    index.append(groups.where("is_new"), batch)
    return members, groups


def _resolve(docs: DataFrame, index: DigestIndex | None, scratch: Scratch, id_col: str, text: str, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """``resolve`` against the given index, or one that only lives for this call."""
    if index is not None:
        return resolve(docs, index, scratch, id_col, text, batch)
    with DigestIndex(docs.sparkSession, f"{scratch.path}/index") as own:
        return resolve(docs, own, scratch, id_col, text, batch)


def annotate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size`` (in this batch), ``kept``, ``text_sha256``.

    A null text counts as empty.  The smallest id of equal texts stays, nulls last; of rows that
    repeat both id and text, all bear ``kept``: they are the same row, and ``deduplicate`` leaves
    one of them.  Texts the index knows from earlier batches keep the earlier document; ``batch``
    names this one, for a run that may have to be repeated.  Texts of any length are hashed whole.
    Extra columns are ignored, whatever their names; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    members, groups = _resolve(docs, index, scratch, id_col, text, batch)
    joined = members.join(groups.hint("merge"), "digest")
    kept = F.col("is_new") & F.col("id").eqNullSafe(F.col("win_id")) & (F.col("mark") == F.col("win_mark"))
    return joined.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """The documents whose text is new, one of each text, with the columns they came with.

    Nulls, ties, repeated rows and batches as in ``annotate``; of rows that repeat id and text one
    stays.  A null text that stays is null.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    _, groups = _resolve(docs, index, scratch, id_col, text, batch)
    return keep_winners(docs, groups.where("is_new"), id_col, text)
