"""Tables that a job writes between its steps, in the folder driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster; without it a cluster's executors would
write to disks of their own, so it must be set there.  On a local master a temporary folder of this
process stands in, which is removed at exit.  Tables in a named folder stay until ``clear``: what an
operator returns may still read them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete the tables of all calls of this process so far; results not yet used are lost with them."""
    while _written:
        delete(spark, _written.pop())


class Shared:
    """One folder for the tables of one call of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _written.append(self.path)

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` as Parquet and read it back: lineage ends here, and a lost executor costs
        no more than reading the files again."""
        where = f"{self.path}/{name}"
        frame.write.mode("overwrite").option("compression", "zstd").parquet(where)
        return self.spark.read.schema(frame.schema).parquet(where)

    def drop(self, name: str = "") -> None:
        """Delete a table that no later step reads."""
        delete(self.spark, f"{self.path}/{name}".rstrip("/"))
