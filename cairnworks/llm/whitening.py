"""Embedding whitening: exact sums, a covariance in double-double, and an eigen-solve of the small matrix.

Vectors are taken as integers x = floor(64 c) + 1000000. One scan gives n and the exact sums S, a second one the outer
products of x - S/n. These are accumulated in double-double: each product is split without error (two_prod), each
addition keeps its rounding error (two_sum), a block of rows is added up as a tree, and a task returns one row with
the high and the low parts, which are merged in two rounds across tasks. So neither the offset nor the number of rows costs
digits. The D x D matrix comes to the driver (D, the width of the vectors, does not grow with the rows), where LAPACK's
symmetric solver reduces it to tridiagonal form and divides and conquers. A third scan holds the whitened values
against the identity, a fourth returns them.

Edge cases: a vector that is null, empty, or holds null or non-finite entries is left out, and so is one whose length is not the most
common one (of equally common ones the longest); 64 c is clamped to +-2^52, so that x is exact. Rows that repeat, also in vec_id,
count each time; a null vec_id is kept. A component without variance (eigenvalue at most RANK times the largest, as when
there is one row) has null `whitened` and is left out of `identity_error`, which is null if none is left; `explained` is null
if nothing varies. `deviation` is exact, or null where it exceeds a long. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.llm.common import pieces, read

SCALE, OFFSET, CLAMP = 64, 1_000_000, 1 << 52
COMPONENTS = 32
#: Eigenvalues up to this share of the largest are no variance but rounding.
RANK = 1e-13
#: Numbers in a block of outer products.
BLOCK = 1 << 17
#: Lengths of vectors that a task counts at once.
LENGTHS = 64

DD = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> DD:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_prod(a: np.ndarray, b: np.ndarray) -> DD:
    """The rounded product and its exact error, by halves of 26 bits."""

    def halves(v: np.ndarray) -> DD:
        c = 134217729.0 * v
        high = c - (c - v)
        return high, v - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def dd_add(a: DD, b: DD) -> DD:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = _renormal(s, e + t)
    return _renormal(s, e + f)


def _renormal(s: np.ndarray, e: np.ndarray) -> DD:
    high = s + e
    return high, e - (high - s)


def products(rows: DD) -> DD:
    """The sum over rows of the upper triangles of their outer products, for centred rows as (high, low) of shape (n, d)."""
    d = rows[0].shape[1]
    i, j = np.triu_indices(d)
    total = np.zeros(len(i)), np.zeros(len(i))
    step = max(1, BLOCK // len(i))
    for begin in range(0, len(rows[0]), step):
        high, low = rows[0][begin : begin + step], rows[1][begin : begin + step]
        p, e = two_prod(high[:, i], high[:, j])
        block = _renormal(p, e + (high[:, i] * low[:, j] + low[:, i] * high[:, j]))
        while len(block[0]) > 1:
            n = len(block[0]) // 2
            added = dd_add((block[0][:n], block[1][:n]), (block[0][n : 2 * n], block[1][n : 2 * n]))
            block = tuple(np.concatenate([x, rest[2 * n :]]) for x, rest in zip(added, block, strict=True))
        total = dd_add(total, (block[0][0], block[1][0]))
    return total


def remaining(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors whose entries are all finite numbers."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(CLAMP))), F.lit(float(-CLAMP)))) + OFFSET)
    return embeddings.filter((F.size("embedding") > 0) & finite).select("vec_id", x.alias("x"))


def _matrix(column: pa.ListArray, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, n, sums as text) of a task: exact, for a batch of longs below 2^53 can't overflow."""
    held: dict[int, tuple[int, list[int]]] = {}

    def out() -> pa.RecordBatch:
        rows = [(k, n, [str(s) for s in sums]) for k, (n, sums) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["length", "n", "sums"])

    for batch in batches:
        lengths = batch.column("x").value_lengths().to_numpy()
        for length in np.unique(lengths):
            rows = _matrix(batch.column("x").filter(pa.array(lengths == length)), int(length))
            n, sums = held.get(int(length), (0, [0] * int(length)))
            parts = [rows[k : k + 512].sum(0) for k in range(0, len(rows), 512)]
            held[int(length)] = n + len(rows), [s + sum(int(p[k]) for p in parts) for k, s in enumerate(sums)]
            if len(held) > LENGTHS:
                yield out()
    if held:
        yield out()


def fit_sums(x: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sums of the vectors of the most common length (0 and [] if there are none)."""
    parts = x.mapInArrow(_sums, "length int, n long, sums array<string>")
    sums = parts.select("length", "n", F.posexplode("sums").alias("at", "s"))
    sums = sums.groupBy("length", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    best = sums.groupBy("length").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("s")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()  # one row
    return (best[0]["n"], [int(s["s"]) for s in best[0]["s"]]) if best else (0, [])


def centred(rows: np.ndarray, n: int, sums: list[int]) -> DD:
    """x - S/n in double-double: the whole part of the mean leaves in integers, its fraction in two doubles."""
    whole = np.array([s // n for s in sums], np.int64)
    parts = [Fraction(s % n, n) for s in sums]
    high = np.array([float(p) for p in parts])
    low = np.array([float(p - Fraction(float(p))) for p in parts])
    s, e = two_sum((rows - whole).astype(np.float64), -high[None, :])
    return _renormal(s, e - low)


def _partial_products(batches: Iterator[pa.RecordBatch], rows_of: Callable[[pa.RecordBatch], DD]) -> Iterator[pa.RecordBatch]:
    """One row for the task: the products of its rows, each with a 1 appended, so that they hold the rows' sums too."""
    total = None
    for batch in batches:
        high, low = rows_of(batch)
        one = np.ones((len(high), 1))
        made = products((np.hstack([high, one]), np.hstack([low, one - 1])))
        total = made if total is None else dd_add(total, made)
    if total is not None:
        yield _row(*total)


def _row(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([high.tolist()], pa.list_(pa.float64())), pa.array([low.tolist()], pa.list_(pa.float64()))], ["high", "low"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for high, low in zip(batch.column("high"), batch.column("low"), strict=True):
            row = np.array(high.as_py()), np.array(low.as_py())
            total = row if total is None else dd_add(total, row)
    if total is not None:
        yield _row(*total)


def covariance(x: DataFrame, rows_of: Callable[[pa.RecordBatch], DD], d: int, n: int) -> DD:
    """The d x d covariance of the rows that `rows_of` makes from batches of x, divisor n, as (high, low).

    Rows come centred; what their rounding leaves of a mean is taken off the sum of products in double-double. Partial
    sums are one row a task, merged by the square root of the number of partitions first.
    """
    kind = "high array<double>, low array<double>"
    parts = x.mapInArrow(partial(_partial_products, rows_of=rows_of), kind)
    parts = parts.repartition(max(1, isqrt(pieces(x.sparkSession)))).mapInArrow(_merge, kind).repartition(1).mapInArrow(_merge, kind)
    got = parts.first()  # one row, whose size is d squared
    whole = np.zeros((2, d + 1, d + 1))
    whole[0][np.triu_indices(d + 1)], whole[1][np.triu_indices(d + 1)] = got["high"], got["low"]
    i, j = np.triu_indices(d)
    sums = whole[0, :d, d] + whole[1, :d, d]
    p, e = two_prod(sums[i] / n, sums[j])
    high, low = dd_add((whole[0, i, j], whole[1, i, j]), (-p, -e))
    out = np.zeros((2, d, d))
    out[0, i, j] = out[0, j, i] = high / n
    back, error = two_prod(high / n, np.full(len(high), float(n)))
    out[1, i, j] = out[1, j, i] = ((high - back) - error + low) / n
    return out[0], out[1]


def _centred_rows(batch: pa.RecordBatch, n: int, sums: list[int]) -> DD:
    column = batch.column("x")
    rows = _matrix(column.filter(pa.array(column.value_lengths().to_numpy() == len(sums))), len(sums))
    return centred(rows, n, sums)


def _whitened_rows(batch: pa.RecordBatch, n: int, sums: list[int], axes: np.ndarray) -> DD:
    high, low = _centred_rows(batch, n, sums)
    made = high @ axes + low @ axes
    return made, np.zeros_like(made)


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n x - S)^2 of each row, exact; None beyond a long."""
    most = max((int(np.abs(rows).max(initial=0)) * n + max(map(abs, sums), default=0)), 1)
    if most * most * rows.shape[1] < 1 << 63:
        return ((rows * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = rows.astype(object) * n - np.array(sums, object)
    return [int(v) if v < 1 << 63 else None for v in (exact * exact).sum(1)]


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining vector and component."""
    x = remaining(embeddings)
    kind = f"vec_id {dict(embeddings.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums = fit_sums(x)
    if not n:
        return embeddings.sparkSession.createDataFrame([], kind)
    d = len(sums)
    high, low = covariance(x, partial(_centred_rows, n=n, sums=sums), d, n)
    values, vectors = np.linalg.eigh(high + low)  # LAPACK syevd: tridiagonal reduction, then divide and conquer
    values, vectors = values[::-1].clip(min=0.0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    k = min(components, d)
    real = int((values[:k] > RANK * values[0]).sum()) if values[0] > 0 else 0
    axes = np.ascontiguousarray(vectors[:, :real] / np.sqrt(values[:real]))
    error = None
    if real:
        found = covariance(x, partial(_whitened_rows, n=n, sums=sums, axes=axes), real, n)
        error = float(np.abs((found[0] - np.eye(real)) + found[1]).max())
    trace = float(np.trace(high) + np.trace(low))
    explained = [float(v) / trace if trace > 0 else None for v in values[:k]]

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(batch.column("x").value_lengths().to_numpy() == d))
            m = batch.num_rows
            if not m:
                continue
            rows = _matrix(batch.column("x"), d)
            made = np.full((m, k), np.nan)
            high, low = centred(rows, n, sums)
            made[:, :real] = high @ axes + low @ axes
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviations(rows, n, sums), pa.int64()).take(each),
                    pa.array(made.ravel(), mask=np.tile(np.arange(k) >= real, m)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(result, kind)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))
