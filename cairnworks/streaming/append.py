"""Exactly-once appends of event batches, and the marks up to which sources have been read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The batches of a folder, or None before the first one."""
    try:
        return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    except AnalysisException:
        return None


def append_once(folder: str, keys: Sequence[str], at: str, source: str = "source") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that adds to `folder` the rows of a batch whose key no other batch has stored, and the batch's marks.

    A batch writes a folder of its own, `events/batch=<id>`, and is compared with the others only, so one that runs again, killed
    at any point before, leaves what it would have left at once. Keys compare with nulls equal and must imply `at`, which bounds what is
    read of the store: rows of the batch's earliest time or later, or without a time. Of several rows of a key in a batch the first in time, then
    by content, stays. Marks, the latest `at` of each source, are written last, so a batch without marks is one to run again.
    """
    events, marks = f"{folder}/events", f"{folder}/marks"

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            others = [c for c in rows.columns if c not in keys]
            first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(F.col(at), F.to_json(F.struct(*others)))).alias("_row")).select(*keys, "_row.*").select(*rows.columns)
            stored = _stored(spark, events)
            if stored is not None:
                begin = rows.agg(F.min(at).alias("begin")).first()["begin"]
                stored = stored.filter(F.col("batch") != batch)
                stored = stored.filter(F.col(at).isNull() | (F.col(at) >= F.lit(begin))) if begin is not None else stored.filter(F.col(at).isNull())
                old = stored.select(*(F.col(k).alias(f"_{k}") for k in keys))
                on = F.lit(True)
                for k in keys:
                    on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
                first = first.join(old, on, "left_anti")
            first.write.mode("overwrite").parquet(f"{events}/batch={batch}")
            rows.groupBy(source).agg(F.max(at).alias("mark")).write.mode("overwrite").parquet(f"{marks}/batch={batch}")
        finally:
            rows.unpersist()

    return run


def appended(spark: SparkSession, folder: str) -> DataFrame | None:
    """All rows stored so far; None before the first batch."""
    stored = _stored(spark, f"{folder}/events")
    return None if stored is None else stored.drop("batch")


def read_since(rows: DataFrame, folder: str, at: str, overlap: str = "3 days", source: str = "source") -> DataFrame:
    """The rows to read next: of each source those at or after its mark less the overlap, all of a source without a mark, and those without a time."""
    stored = _stored(rows.sparkSession, f"{folder}/marks")
    if stored is None:
        return rows
    marks = stored.groupBy(F.col(source).alias("_source")).agg(F.max("mark").alias("_mark"))  # a row a source
    since = F.col("_mark") - F.expr(f"INTERVAL {overlap}")
    joined = rows.join(marks, F.col(source).eqNullSafe(F.col("_source")), "left")
    return joined.filter(F.col("_mark").isNull() | F.col(at).isNull() | (F.col(at) >= since)).drop("_source", "_mark")
