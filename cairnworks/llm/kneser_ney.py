"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte 5-grams, trained on trusted text.

1. Every task cuts its documents into blocks of about BLOCK_BYTES and emits each block's texts (compressed) and its
   distinct grams with their counts in trusted documents, dealt to shards by the two bytes before the last. All that
   the model needs of orders 5 to 3 for a gram lies in the gram's shard: its suffixes and all their contexts
   hold these two bytes at the same place.
2. The counts of a shard are merged (in two steps, so that no task gathers a common shard of all blocks), which
   also gives the discounts and the orders 2 and 1: at most 65,536 byte pairs, whatever the input's size.
3. Count join: the grams that blocks ask for meet their shard's counts, and the log probabilities return to the
   blocks, where documents are scored. Documents are kept between two quantiles of their language's trusted ones.

All trusted documents are counted and all documents scored, whole. Nothing is pruned, so what is gathered grows
with the corpus, if less than in proportion: ten times the trusted text (sf0.01 to sf0.1) has 1.8 times the 5-grams.
Edge cases: a null or empty text has null perplexity and is not kept; a language without trusted documents (or a
null one) takes the quantiles of all trusted ones; without any trusted document all texts with bytes are kept; rows
of one doc_id are scored one by one and share their label; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnworks.llm.bytetext import slices, texts_of
from cairnworks.llm.common import materialise, materialise_by, pieces, read

ORDER = 5
BLOCK_BYTES = 12 << 20
LOW, HIGH = 0.005, 0.995
#: How far beyond the quantiles a document may lie, as a share of log perplexity.
SLACK = 0.02
#: Ids of at most so many trusted documents are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Blocks whose grams of one shard are worked on in one place.
BLOCKS_AT_ONCE = 64
_U = np.uint64


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the gram that ends at each byte, row of each byte); texts begin with zero bytes."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(data)) - offsets[:-1][row] if len(data) else np.zeros(0, np.int64)
    out = data.astype(_U)
    for k in range(1, ORDER):
        before = np.zeros(len(data), _U)
        before[k:] = data[:-k]
        before[place < k] = 0
        out |= before << _U(8 * k)
    return out, row


def shard_of(g: np.ndarray, n: int) -> np.ndarray:
    pair = (g >> _U(8)) & _U(0xFFFF)
    return ((pair * _U(0x9E3779B97F4A7C15)) >> _U(40)).astype(np.int64) % n


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of several (grams, counts) and the sums of their counts."""
    g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(c, first) if len(g) else c


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _pack_grams(g: np.ndarray) -> bytes:
    return _pack(np.diff(g, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()) if len(g) else b""


def _unpack_grams(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(blob, 8 * n, "u1").reshape(8, n).T.copy().view("<u8").reshape(-1), dtype=_U) if n else np.zeros(0, _U)


def blocks_of(documents: DataFrame, n_shards: int) -> DataFrame:
    """documents(doc_id, lang, text, trusted) -> block rows (block, texts) and gram rows (block, shard, n, grams, counts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "shard", "n", "grams", "counts", "texts"]
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = part << 24 | number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for x in held:
                    writer.write_batch(x)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names)
            g, c = merged(counted)
            shard = shard_of(g, n_shards)
            order = np.argsort(shard, kind="stable")
            g, c, shard = g[order], c[order], shard[order]
            begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(g) else []
            cuts = [(a, b) for a, b in zip(begin, [*begin[1:], len(g)], strict=True)] if len(g) else []
            rows = [[block] * len(cuts), [int(shard[a]) for a, _ in cuts], [int(b - a) for a, b in cuts], [_pack_grams(g[a:b]) for a, b in cuts], [_pack(c[a:b].astype("<u4")) for a, b in cuts], [None] * len(cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

        for batch in batches:
            for rows in slices(batch):
                data, offsets = texts_of(rows.column("text"))
                g, row = grams(data, offsets)
                trusted = rows.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
                unique, inverse = np.unique(g, return_inverse=True)
                counted.append((unique, np.bincount(inverse, trusted[row], len(unique)).astype(np.int64)))
                if len(counted) > 6:
                    counted[:] = [merged(counted)]
                held.append(rows)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from flush()
                    held, counted, size, number = [], [], 0, number + 1
        if held:
            yield from flush()

    rows = documents.select("doc_id", "lang", "text", "trusted")
    return rows.mapInArrow(work, "block long, shard long, n long, grams binary, counts binary, texts binary")


def merged_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Gram rows with the counts of trusted text merged by keys; grams that trusted text lacks go."""

    def work(table: pa.Table) -> pa.Table:
        parts = [(_unpack_grams(g.as_py(), n), _unpack(c.as_py(), n, "<u4").astype(np.int64)) for n, g, c in zip(table.column("n").to_pylist(), table.column("grams"), table.column("counts"), strict=True)]
        g, c = merged(parts)
        g, c = g[c > 0], c[c > 0]
        return pa.table({"shard": table.column("shard")[:1], "salt": table.column("salt")[:1], "n": pa.array([len(g)], pa.int64()), "grams": pa.array([_pack_grams(g)], pa.binary()), "counts": pa.array([_pack(c.astype("<u4"))], pa.binary())})

    return rows.select("shard", "salt", "n", "grams", "counts").groupBy(*keys).applyInArrow(work, "shard long, salt long, n long, grams binary, counts binary")


class ShardModel:
    """Orders ORDER to 3 of one shard: sorted grams with counts (continuation counts below the highest)."""

    def __init__(self, g: np.ndarray, c: np.ndarray):
        self.levels = []
        for order in range(ORDER, 2, -1):
            self.levels.append((order, g, c))
            g, c = np.unique(g & _U((1 << 8 * (order - 1)) - 1), return_counts=True)
        self.pairs = (g, c)  # byte pairs, and how many bytes stand before them in this shard

    def counts_of_counts(self) -> np.ndarray:
        return np.array([[np.count_nonzero(c == k) for k in (1, 2, 3, 4)] for _, _, c in self.levels])

    def log_probability(self, asked: np.ndarray, pair_probability: np.ndarray, discounts: np.ndarray) -> np.ndarray:
        p = pair_probability[(asked & _U(0xFFFF)).astype(np.int64)]
        for (order, g, c), d in zip(self.levels[::-1], discounts[::-1], strict=True):
            if not len(g):
                continue
            taken = d[np.minimum(c, 3) - 1]
            context, first = np.unique(g >> _U(8), return_index=True)
            total, saved = np.add.reduceat(c, first), np.add.reduceat(taken, first)
            tail = asked & _U((1 << 8 * order) - 1)
            at = np.minimum(np.searchsorted(context, tail >> _U(8)), len(context) - 1)
            seen = context[at] == tail >> _U(8)
            own = np.minimum(np.searchsorted(g, tail), len(g) - 1)
            mass = np.where(g[own] == tail, np.maximum(c[own] - taken[own], 0), 0) / total[at]
            p = np.where(seen, mass + saved[at] / total[at] * p, p)
        return np.log(p)


def discounts_of(n: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from the numbers of grams seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(raw, 0.05, [0.95, 1.95, 2.95])


def pair_model(count: np.ndarray) -> np.ndarray:
    """Order 2 from the continuation counts of all byte pairs (65,536 numbers), over order 1, over even chances."""
    count = count.reshape(256, 256).astype(float)
    one = (count > 0).sum(0).astype(float)
    flat = np.full(256, 1 / 256)
    d1 = discounts_of([(one == k).sum() for k in (1, 2, 3, 4)])
    if one.sum():
        taken = np.where(one > 0, d1[np.clip(one.astype(int), 1, 3) - 1], 0)
        flat = (np.maximum(one - taken, 0) + taken.sum() * flat) / one.sum()
    d2 = discounts_of([(count == k).sum() for k in (1, 2, 3, 4)])
    taken = np.where(count > 0, d2[np.clip(count.astype(int), 1, 3) - 1], 0)
    total = count.sum(1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = (np.maximum(count - taken, 0) + taken.sum(1, keepdims=True) * flat) / total
    return np.where(total > 0, p, flat).reshape(-1)


def perplexities(documents: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """documents(doc_id, lang, text), trusted_ids(doc_id) -> doc_id, lang, trusted, n_bytes, log_perplexity (a byte)."""
    spark = documents.sparkSession
    n_shards = 4 * pieces(spark)
    ids = materialise(trusted_ids.select(F.col("doc_id").alias("_trusted")).filter("_trusted is not null").distinct(), "trusted")
    small = ids.count() <= BROADCAST_ROWS
    rows = documents.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("_trusted"), "left")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text"), F.col("_trusted").isNotNull().alias("trusted"))
    made = materialise_by(blocks_of(rows, n_shards), "blocks", "block", pieces(spark))
    asked = made.filter("shard is not null").select("block", "shard", "n", "grams", "counts")
    salts = max(1, -(-made.filter("texts is not null").count() // BLOCKS_AT_ONCE))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    counts = merged_counts(asked, "shard", "salt")
    if salts > 1:
        counts = merged_counts(counts.withColumn("salt", F.lit(0).cast("long")), "shard")
    counts = materialise(counts, "counts")

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pairs = np.zeros((ORDER - 2, 4), np.int64), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for k, g, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                model = ShardModel(_unpack_grams(g.as_py(), k), _unpack(c.as_py(), k, "<u4").astype(np.int64))
                n += model.counts_of_counts()
                pairs[model.pairs[0].astype(np.int64)] += model.pairs[1]
        at = np.flatnonzero(pairs)
        keys = np.concatenate([-1 - np.arange(n.size), at])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([n.reshape(-1), pairs[at]]))], ["k", "v"])

    # At most 65,536 byte pairs and four counts of counts an order.
    totals = counts.select("n", "grams", "counts").mapInArrow(figures, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    k, v = totals.column("k").to_numpy(), totals.column("v").to_numpy()
    n, pairs = np.zeros(4 * (ORDER - 2), np.int64), np.zeros(1 << 16, np.int64)
    n[-1 - k[k < 0]], pairs[k[k >= 0]] = v[k < 0], v[k >= 0]
    discounts = np.array([discounts_of(x) for x in n.reshape(-1, 4)])
    held = spark.sparkContext.broadcast((pair_model(pairs), discounts))

    def answer(wanted: pa.Table, model: pa.Table) -> pa.Table:
        k = model.column("n")[0].as_py() if model.num_rows else 0
        part = ShardModel(_unpack_grams(model.column("grams")[0].as_py(), k), _unpack(model.column("counts")[0].as_py(), k, "<u4").astype(np.int64)) if k else ShardModel(np.zeros(0, _U), np.zeros(0, np.int64))
        logs = [_pack(part.log_probability(_unpack_grams(g.as_py(), m), *held.value).astype("<f4")) for m, g in zip(wanted.column("n").to_pylist(), wanted.column("grams"), strict=True)]
        return pa.table({"block": wanted.column("block"), "n": wanted.column("n"), "grams": wanted.column("grams"), "logs": pa.array(logs, pa.binary())})

    model = counts.drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))) if salts > 1 else counts
    answers = asked.groupBy("shard", "salt").cogroup(model.select("shard", "salt", "n", "grams", "counts").groupBy("shard", "salt")).applyInArrow(answer, "block long, n long, grams binary, logs binary")

    def score(texts: pa.Table, answered: pa.Table) -> pa.Table:
        known = [(_unpack_grams(g.as_py(), m), _unpack(x.as_py(), m, "<f4")) for m, g, x in zip(answered.column("n").to_pylist(), answered.column("grams"), answered.column("logs"), strict=True)]
        g, logs = (np.concatenate([x[i] for x in known]) for i in (0, 1)) if known else (np.zeros(0, _U), np.zeros(0, "<f4"))
        find = _Places(g)
        out = []
        for blob in texts.column("texts"):
            for batch in pa.ipc.open_stream(blob.as_py()):
                data, offsets = texts_of(batch.column("text"))
                asked_for, row = grams(data, offsets)
                total = np.bincount(row, logs[find(asked_for)], batch.num_rows) if len(data) else np.zeros(batch.num_rows)
                size = np.diff(offsets)
                value = pa.array(-total / np.maximum(size, 1), mask=size == 0)
                out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("trusted"), pa.array(size), value], ["doc_id", "lang", "trusted", "n_bytes", "log_perplexity"]))
        return pa.Table.from_batches(out)

    return made.filter("texts is not null").select("block", "texts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, lang string, trusted boolean, n_bytes long, log_perplexity double")


class _Places:
    """Where each of many grams stands in a list of distinct ones that holds them all."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(len(keys)).bit_length() + 1)
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = (self._hash(keys[left]) + step) & (1 << self.bits) - 1
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            left = left[self.table[at] != left]
            step += 1

    def _hash(self, g: np.ndarray) -> np.ndarray:
        return ((g * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        at = self._hash(asked)
        found = self.table[at]
        wrong = np.flatnonzero(self.keys[found] != asked)
        step = 1
        while len(wrong):
            found[wrong] = self.table[(at[wrong] + step) & (1 << self.bits) - 1]
            wrong = wrong[self.keys[found[wrong]] != asked[wrong]]
            step += 1
        return found


def limits(scored: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(lang, low, high) of the trusted documents' log perplexity, and a row with a null lang and all = true for all of them.

    Values are counted in steps of 0.001, so a language's window runs over some thousand rows whatever its size.
    """
    steps = scored.filter("trusted and log_perplexity is not null").select(F.explode(F.array(F.struct("lang", F.lit(False).alias("overall")), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("overall")))).alias("g"), F.round("log_perplexity", 3).alias("v"))
    steps = steps.groupBy("g", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g")
    steps = steps.withColumn("below", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
    return steps.groupBy("g").agg(F.min(F.when(F.col("below") >= F.lit(low) * F.col("all"), F.col("v"))).alias("low"), F.min(F.when(F.col("below") >= F.lit(high) * F.col("all"), F.col("v"))).alias("high")).select("g.lang", "g.overall", "low", "high")


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (a byte), low and high limits, keep."""
    scored = materialise(perplexities(documents, labels.filter("quality = 1").select("doc_id")), "perplexity")
    found = materialise(limits(scored), "limits")  # a row a language
    overall = found.filter("overall").select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    per_language = found.filter("not overall and lang is not null").select(F.col("lang").alias("_lang"), "low", "high")
    first = overall.first()
    rows = scored.join(per_language, F.col("lang") == F.col("_lang"), "left")
    low, high = (F.coalesce(F.col(c), F.lit(None if first is None else first[f"_{c}"]).cast("double")) for c in ("low", "high"))
    inside = F.coalesce((F.col("log_perplexity") >= low * (1 - SLACK)) & (F.col("log_perplexity") <= high * (1 + SLACK)), F.lit(True))
    return rows.select("doc_id", "lang", "n_bytes", F.exp("log_perplexity").alias("perplexity"), F.exp(low).alias("low"), F.exp(high).alias("high"), (F.col("log_perplexity").isNotNull() & inside).alias("keep"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
