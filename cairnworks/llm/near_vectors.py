"""Near-duplicate embeddings by sorted projection passes.

1. Equal vectors of a label (and length) become one class, counted before the shuffle, so copies cost nothing below.
2. Each pass gives a class a code, the signs of 64 random projections side by side, and orders the classes of a label by it.
   Every class is compared with the WINDOW classes before it. What travels is the vector in 8-bit steps with the length of its own
   error: the product of two such vectors differs from the true cosine by no more than these errors allow, so most
   pairs are decided by proof, and the few others are compared in double precision by a join. Passes are
   independent; their number follows from the number of classes (see `passes`), so that a pair on the
   threshold is met with probability 1 - MISSED at any size.
3. Verified pairs are united across passes into components (of a window only a spanning star is kept, so a large group
   gives rows in proportion to its size).
4. Links within a component are all counted, met or not. Vectors within half the threshold's angle of the component's mean
   are linked to each other by the triangle inequality, which settles a group of near copies of any size without pairs. What lies
   further out is compared, in double precision, with the component in blocks of BLOCK rows, a task for each pair of blocks.

So each link counted has a cosine of LEAST or more. Missed are only pairs of which no pass connects the two ends, not even by others.

Edge cases: a vector that is null, empty, zero, or holds null or non-finite components, or whose label or vec_id is null, links
with nothing and is its own component; vectors of different lengths do not link; rows that share a vec_id are vectors of their
own, each of which counts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.llm.common import materialise, pieces, read
from cairnworks.llm.components import components

LEAST = 0.93
WINDOW = 64
#: A pair of cosine LEAST is met by no pass with this probability at most.
MISSED = 0.05
#: Signs in a code.
BITS = 64
#: Rows of a window task that are compared at once, besides the window before them.
CHUNK = 256
#: Rows of a component in a block.
BLOCK = 1024
#: Rounding of double precision and of the angles is far below this.
SLACK = 1e-6


def passes(n: int, least: float = LEAST, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes for n classes: two vectors of cosine `least` share one sign with probability 1 - angle / pi, and are in one
    window once they share about log2(n / window) leading signs."""
    met = (1 - math.acos(least) / math.pi) ** math.log2(max(n / window, 1))
    return 2 if met >= 1 else max(2, math.ceil(math.log(missed) / math.log(1 - met)))


def usable(vectors: DataFrame) -> Column:
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda c: c != 0), F.lit(False))


def _rows(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, matrix) for each length of vector in a binary column of doubles."""
    held = [np.frombuffer(v.as_buffer(), np.float64) for v in batch.column(column)]
    lengths = np.array([len(v) for v in held])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, np.stack([held[i] for i in at])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes, with a digest of the vector as it was."""
    for batch in batches:
        digests, units = [], []
        for v in batch.column("embedding"):
            given = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
            digests.append(hashlib.blake2b(given.tobytes(), digest_size=16).digest())
            scaled = given / np.abs(given).max()
            units.append((scaled / np.sqrt(scaled @ scaled)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("space"), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "space", "digest", "unit"])


def with_units(vectors: DataFrame) -> DataFrame:
    """(vec_id, space, digest, unit) of the usable vectors; vectors of one space, a label and a length, may link."""
    space = F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string"))
    rows = vectors.filter(usable(vectors)).select(F.col("vec_id").cast("long").alias("vec_id"), space.alias("space"), "embedding")
    return rows.mapInArrow(_units, "vec_id long, space string, digest binary, unit binary")


def _codes(batches: Iterator[pa.RecordBatch], n_passes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A row for each class and pass: the code, and the vector in 8-bit steps (step, steps, length of what they leave)."""
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, unit in _rows(batch, "unit"):
            d = unit.shape[1]
            if d not in planes:
                planes[d] = np.random.default_rng([seed, d]).standard_normal((d, n_passes * BITS))
            step = np.abs(unit).max(1) / 127
            steps = np.rint(unit / step[:, None]).astype(np.int8)
            left = np.linalg.norm(unit - steps * step[:, None], axis=1)
            bits = (unit @ planes[d] >= 0).reshape(len(unit), n_passes, BITS)
            codes = (bits @ weights).astype(np.uint64).view(np.int64) ^ np.int64(-(2**63))  # signed order is that of the signs
            some = batch.take(pa.array(at))
            packed = pa.array([s.tobytes() for s in steps], pa.binary())
            for k in range(n_passes):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), some.column("space"), pa.array(codes[:, k]), some.column("vec"), packed, pa.array(step), pa.array(left)], ["pass", "space", "code", "vec", "steps", "step", "left"])


CODES = "pass int, space string, code long, vec long, steps binary, step double, left double"


def _compare(vec: np.ndarray, steps: np.ndarray, step: np.ndarray, left: np.ndarray, begin: int, least: float, window: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of each row from `begin` on with the rows before it in its window: a spanning star of the sure ones, and the undecided."""
    kind = np.float32 if steps.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers stay exact
    held = steps.astype(kind)
    cosine = (held[begin:] @ held.T).astype(np.float64) * step[begin:, None] * step[None, :]
    bound = left[begin:, None] + left[None, :] * (1 + left[begin:, None]) + SLACK
    behind = np.arange(begin, len(vec))[:, None] - np.arange(len(vec))[None, :]
    near = (behind > 0) & (behind <= window) & (cosine + bound >= least)
    if not near.any():
        return []
    i, j = np.nonzero(near)
    sure = cosine[i, j] - bound[i, j] >= least
    i += begin
    label = np.arange(len(vec))
    while True:
        before = label.copy()
        np.minimum.at(label, i[sure], label[j[sure]])
        np.minimum.at(label, j[sure], label[i[sure]])
        label = label[label]
        if (label == before).all():
            break
    joined = np.flatnonzero(label != np.arange(len(vec)))
    open_ = ~sure & (label[i] != label[j])
    return [(vec[joined], vec[label[joined]], True), (vec[i[open_]], vec[j[open_]], False)]


def _windows(batches: Iterator[pa.RecordBatch], least: float, window: int) -> Iterator[pa.RecordBatch]:
    """(a, b, sure) of rows sorted by pass, space and code; the last `window` rows are held over to the next batch."""
    last_key, tail = None, None
    for batch in batches:
        which, spaces = batch.column("pass").to_numpy(), batch.column("space").dictionary_encode()
        space = spaces.indices.to_numpy()
        cuts = np.flatnonzero((which[1:] != which[:-1]) | (space[1:] != space[:-1])) + 1
        found = []
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if begin == end:
                continue
            run = batch.slice(begin, end - begin)
            key = (which[begin], spaces.dictionary[space[begin]].as_py())
            rows = [run.column("vec").to_numpy(), np.stack([np.frombuffer(v.as_buffer(), np.int8) for v in run.column("steps")]), run.column("step").to_numpy(), run.column("left").to_numpy()]
            first = 0
            if key == last_key:
                first = len(tail[0])
                rows = [np.concatenate([a, b]) for a, b in zip(tail, rows, strict=True)]
            for at in range(first, len(rows[0]), CHUNK):
                low = max(0, at - window)
                found += _compare(*(r[low : at + CHUNK] for r in rows), at - low, least, window)
            last_key, tail = key, [r[-window:].copy() for r in rows]
        if found:
            sure = np.concatenate([np.full(len(a), s) for a, _, s in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found])), pa.array(sure)], ["a", "b", "sure"])


def _exact(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [float(np.frombuffer(x.as_buffer(), np.float64) @ np.frombuffer(y.as_buffer(), np.float64)) >= least for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])


def verified_edges(classes: DataFrame, n: int, least: float = LEAST, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """(a, b): pairs of classes(vec, space, unit) of cosine >= least that connect all that the passes met."""
    spark = classes.sparkSession
    n_passes = passes(n, least, window)
    coded = classes.select("vec", "space", "unit").mapInArrow(partial(_codes, n_passes=n_passes, seed=seed), CODES)
    order = ["pass", "space", "code", "vec"]
    ranges = max(pieces(spark), n * n_passes // 500_000)
    met = coded.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(partial(_windows, least=least, window=window), "a long, b long, sure boolean")
    met = materialise(met.distinct(), "near-met")
    unit = lambda key, name: classes.select(F.col("vec").alias(key), F.col("unit").alias(name))
    unsure = met.filter(~F.col("sure")).join(unit("a", "x"), "a").join(unit("b", "y"), "b").select("a", "b", "x", "y")
    return met.filter("sure").select("a", "b").union(unsure.mapInArrow(partial(_exact, least=least), "a long, b long"))


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = pa.array([np.frombuffer(v.as_buffer(), np.float64) for v in batch.column("unit")], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec", "component", "m")), units], ["vec", "component", "m", "unit"])


def _block_links(left: pa.Table, right: pa.Table, least: float) -> pa.Table:
    """(vec, links) for a block of outer vectors against a block of their component."""
    schema = pa.schema([("vec", pa.int64()), ("links", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    vec, m, unit = ([t.column(c).to_numpy() for t in (left, right)] if c != "unit" else [np.stack(t.column(c).to_pylist()) for t in (left, right)] for c in ("vec", "m", "unit"))
    linked = (unit[0] @ unit[1].T >= least) & (vec[0][:, None] != vec[1][None, :])
    # A pair of outer vectors is met from both sides, one with a core vector once.
    core = right.column("core").to_numpy(zero_copy_only=False).astype(bool)
    counts = [linked @ m[1], np.where(core, m[0] @ linked, 0)]
    return pa.table([pa.array(np.concatenate(vec)), pa.array(np.concatenate(counts).astype(np.int64))], schema=schema)


def component_links(members: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(vec, n_links) for all members(vec, component, m, unit): how many vectors each of a class's m vectors is linked to."""
    rows = materialise(members.mapInArrow(_as_arrays, "vec long, component long, m long, unit array<double>"), "near-members")
    # Written tables, so that the joins below are between plain exchanges, which Spark can split where a component is large.
    mean = materialise(rows.groupBy("component").agg(vector_to_array(Summarizer.mean(array_to_vector("unit"))).alias("mean")), "near-means")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    angle = F.acos(F.greatest(F.least(dot("unit", "mean") / F.sqrt(dot("mean", "mean")), F.lit(1.0)), F.lit(-1.0)))
    core = F.coalesce(angle <= F.lit(math.acos(least) / 2 - SLACK), F.lit(False))
    rows = materialise(rows.join(mean, "component").select(*rows.columns, core.alias("core")), "near-cores")
    total = rows.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("m")).otherwise(0)).alias("n_core"), F.count("*").alias("n"), F.count_if(~F.col("core")).alias("n_outer"))
    total = materialise(total, "near-totals")
    sized = rows.join(total, "component")
    base = sized.select("vec", F.when(F.col("core"), F.col("n_core")).otherwise(F.col("m")).alias("links"))
    mixed = sized.filter("n_outer > 0").withColumns({"i_all": F.ceil(F.col("n_outer") / block).cast("int"), "j_all": F.ceil(F.col("n") / block).cast("int"), "deal": F.xxhash64("vec")})
    left = mixed.filter(~F.col("core")).select("component", F.pmod("deal", "i_all").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_all") - 1)).alias("j"), "vec", "m", "unit")
    right = mixed.select(F.col("component"), F.explode(F.sequence(F.lit(0), F.col("i_all") - 1)).alias("i"), F.pmod("deal", "j_all").cast("int").alias("j"), "vec", "m", "unit", "core")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own beside those of left
    key = ["component", "i", "j"]
    outer = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(partial(_block_links, least=least), "vec long, links long")
    return base.union(outer).groupBy("vec").agg((F.sum("links") - 1).alias("n_links"))


def near_vectors(vectors: DataFrame, least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors(vec_id, label, embedding)."""
    rows = with_units(vectors)
    classes = rows.groupBy("space", "digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"), F.first("unit").alias("unit"))
    # Rows may share a vec_id, so classes have a number of their own; a component is named by its least vec_id.
    classes = materialise(classes.withColumn("vec", F.xxhash64("space", "digest")), "near-classes")
    found = materialise(components(verified_edges(classes, classes.count(), least, window)), "near-components")
    members = classes.join(found, classes["vec"] == found["node"]).select("vec", "component", "m", "unit", "vec_id")
    names = members.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    links = component_links(members.select("vec", "component", "m", "unit"), least)
    joined = links.join(members.select("vec", "component"), "vec").join(names, "component").select("vec", "n_links", "component_id")
    each = classes.select("space", "digest", "vec", "m", F.col("vec_id").alias("least_id")).join(joined, "vec", "left")
    each = each.select("space", "digest", F.coalesce("n_links", F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = rows.select("vec_id", "space", "digest").join(each, ["space", "digest"]).select("vec_id", "n_links", "component_id")
    alone = vectors.filter(~usable(vectors)).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
