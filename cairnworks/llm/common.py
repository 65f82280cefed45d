"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import secrets
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that end a word, as the contracts define them: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: texts run to 100 kB and more, and a batch stands in a task's memory several times.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, in a session whose Arrow batches are small enough for long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where the session names none."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
            folder = tempfile.mkdtemp(prefix="cairnworks-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(paths: Iterable[str], spark: SparkSession) -> None:
    """Delete tables that materialise() wrote (as `folders_of` names them) and that nothing reads any more."""
    for path in paths:
        held = spark._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def folders_of(df: DataFrame) -> set[str]:
    """The folders that a table read from files lies in."""
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def materialise_by(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """Like materialise, in n buckets by a column: a later grouping by it in n partitions reads the buckets without a shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{shared_dir(spark)}/{table}").bucketBy(n, column).saveAsTable(table)
    return spark.table(table)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns: the given ones, with underscores added where df has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def digest_key(spark: SparkSession) -> int:
    """The key of this session's digests, drawn once: the driver hands it to tasks, so a task that runs again makes the same digests."""
    name = "cairnworks.digest.key"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(secrets.randbits(63)))
    return int(spark.conf.get(name))


def pieces(spark: SparkSession) -> int:
    """How many shuffle partitions the session asks for; explicit repartitions follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release_memory() -> None:
    """Give what freed arrays leave behind back to the system: a driver that has trained a model goes on for many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def null_safe_text(df: DataFrame, name: str = "text"):
    return F.coalesce(df[name], F.lit(""))
