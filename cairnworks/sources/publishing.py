"""Published snapshots: written aside, checked, and then made current by one small file, so a reader never sees half of one or an empty one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def current(spark: SparkSession, folder: str) -> dict | None:
    """What is published in a folder: snapshot, rows, digest; None before the first time."""
    files, path = _files(spark, f"{folder}/CURRENT.json")
    if not files.exists(path):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/CURRENT.json").collect()))  # a file of one line


def published(spark: SparkSession, folder: str) -> DataFrame | None:
    held = current(spark, folder)
    return None if held is None else spark.read.parquet(f"{folder}/{held['snapshot']}")


def publish(build: Callable[[], DataFrame], spark: SparkSession, folder: str, check: Callable[[DataFrame], bool] = lambda rows: True) -> tuple[str, str | None]:
    """(outcome, reason): published, unchanged, or skipped, which leaves what was current as it was.

    Skipped are inputs that fail while they are built or written, that have no rows, or that `check` refuses; all but a failure is told from the
    written snapshot, so nothing is computed twice. The same rows in any order are unchanged. Old snapshots stay until one removes them.
    """
    name = f"snapshot-{uuid.uuid4().hex}"
    before = current(spark, folder)
    try:
        build().write.parquet(f"{folder}/{name}")
    except Exception as error:  # the input is offline or broken: whatever it raises, the old snapshot stays
        return "skipped", f"failed: {type(error).__name__}"
    rows = spark.read.parquet(f"{folder}/{name}")
    as_text = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(rows.columns)]
    n, digest = rows.agg(F.count("*"), F.sum(F.xxhash64(*as_text).cast("decimal(38,0)"))).first()
    outcome, reason = "published", None
    if not n:
        outcome, reason = "skipped", "no rows"
    elif not check(rows):
        outcome, reason = "skipped", "refused"
    elif before is not None and (before["rows"], before["digest"]) == (n, str(digest)):
        outcome = "unchanged"
    files, path = _files(spark, f"{folder}/{name}")
    if outcome != "published":
        files.delete(path, True)
        return outcome, reason
    # One file is replaced at once; it is the only thing that readers look at.
    _, aside = _files(spark, f"{folder}/{name}.json")
    stream = files.create(aside, True)
    stream.write(bytearray(json.dumps({"snapshot": name, "rows": n, "digest": str(digest)}).encode()))
    stream.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT.json")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(aside), files.makeQualified(target), options)
    return outcome, reason
