"""Token ids in binary shards, coded by the context-mixing range coder.

A shard is one row of a Parquet table in the shared folder; its `file` is a self-contained image:
magic, counts, the doc_ids, their numbers of ids, the ids in use by falling frequency (their places are the
ranks that are coded) with their shares of order 0, and the blocks, each with its number of ids, coded length and a
CRC-32 of its ids. Blocks run over document borders, start from a fresh model each, and are verified as they are read.

Edge cases: null and empty texts have the end id alone; a null doc_id comes first; rows of one doc_id follow in
the order of their texts; a shard with more than 65536 different ids is split (one such document alone is an error); an empty table gives no shards
and an empty result; extra columns are ignored. Damaged shards raise ValueError.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnworks.llm import range_coder
from cairnworks.llm.bytetext import slices, texts_of
from cairnworks.llm.chunked_encoding import ChunkEncoder
from cairnworks.llm.common import materialise, pieces, read

MAGIC = b"CWTOK2\0\0"
END_ID = 0
#: Ids of a shard at most (a longer document makes a longer one).
SHARD_IDS = range_coder.BLOCK * range_coder.LANES
#: Ids of a batch that is read back, about.
OUT_IDS = 1 << 19
NO_ID = -(2**63)  # stands for a null doc_id in a shard

# Classes of bytes: white space, ASCII letters and digits, ASCII signs that no contraction begins with, and bytes that
# may begin other white space.
_SPACE, _WORD, _SIGN, _OTHER = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[ord("'")] = 0
for _a, _b in ("09", "AZ", "az"):
    _CLASS[ord(_a) : ord(_b) + 1] = _WORD
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = _OTHER
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Chunks that the tokenizers library gets in one string.
_TOGETHER = 500


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Where texts may be cut before a byte-level pre-tokenizer: its words are an optional space with letters, digits
    or signs, or white space, so none goes from a visible character on to ASCII white space, nor from ASCII letters or
    digits on to a sign (but for the apostrophe of contractions)."""
    kind = _CLASS[data]
    out = np.zeros(len(data), bool)
    out[1:] = (kind[1:] == _SPACE) & (kind[:-1] != _SPACE) | (kind[1:] == _SIGN) & (kind[:-1] == _WORD)
    return out


class _ByteLevel:
    """The tokenizers library's own encoding of distinct chunks, and which texts are not to be cut."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        before = settings.get("pre_tokenizer") or {}
        self.cuttable = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not settings.get("normalizer")
        self.added = [x["content"].encode() for x in settings.get("added_tokens", [])]
        # Each character of a byte-level token stands for one byte.
        tokens = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(tokens.values(), default=0) + 1, np.int64)
        for token, number in tokens.items():
            self.token_bytes[number] = len(token)

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with white space beyond ASCII, which may take part in a run, and texts with added tokens."""
        out = np.zeros(len(offsets) - 1, bool)
        if not self.cuttable:
            out[:] = True
            return out
        raw = data.tobytes()
        at = np.flatnonzero(_CLASS[data] == _OTHER)
        for i in np.unique(np.searchsorted(offsets, at, "right") - 1):
            out[i] = _OTHER_SPACE.search(raw[offsets[i] : offsets[i + 1]].decode()) is not None
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        return out

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with white space and end without follow one another as they would in a text, so the
        library gets many in one string; the bytes of its tokens tell where each ends."""
        join = [bool(self.cuttable and c[:1].isspace() and not c[-1:].isspace() and len(c) < 64 and c.isascii()) for c in chunks]
        order = [i for i, j in enumerate(join) if j] + [i for i, j in enumerate(join) if not j]
        joined = sum(join)
        texts = [b"".join(chunks[i] for i in order[a : min(a + _TOGETHER, joined)]).decode() for a in range(0, joined, _TOGETHER)]
        texts += [chunks[i].decode() for i in order[joined:]]
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n_joined = len(range(0, joined, _TOGETHER))
        counts = np.zeros(len(chunks), np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(coded), np.int32, sum(map(len, coded)))
        n_together = sum(map(len, coded[:n_joined]))
        token_ends = np.cumsum(self.token_bytes[ids[:n_together]])
        ends = np.cumsum([len(chunks[i]) for i in order[:joined]]) if joined else np.zeros(0, np.int64)
        last = np.searchsorted(token_ends, ends)
        if joined and not np.array_equal(token_ends[np.minimum(last, len(token_ends) - 1)], ends):
            raise AssertionError("a token goes over the end of a chunk")
        counts[order[:joined]] = np.diff(last, prepend=-1)
        counts[order[joined:]] = [len(c) for c in coded[n_joined:]]
        # Back into the order of the chunks.
        order_counts = counts[order]
        begin = np.empty(len(chunks), np.int64)
        begin[order] = np.cumsum(order_counts) - order_counts
        before = np.cumsum(counts) - counts
        return ids[np.repeat(begin - before, counts) + np.arange(len(ids))], counts


_encoders: dict[str, ChunkEncoder] = {}


def byte_level_encoder(path: str) -> ChunkEncoder:
    """The encoder of a tokenizer file; a worker keeps it, and what it remembers, from task to task."""
    if path not in _encoders:
        _encoders.clear()
        tokenizer = _ByteLevel(path)
        _encoders[path] = ChunkEncoder(chunk_starts, tokenizer.encode_chunks, tokenizer.whole)
    return _encoders[path]


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard of documents, their numbers of ids and all ids (int32) in a row."""
    count = np.bincount(ids) if len(ids) and ids.max() < 1 << 20 else None
    used = np.flatnonzero(count) if count is not None else np.unique(ids)
    if count is None:
        count = np.bincount(np.searchsorted(used, ids), minlength=len(used))
    else:
        count = count[used]
    if len(used) > range_coder.RANKS:
        raise ValueError(f"more than {range_coder.RANKS} different ids in a shard")
    order = np.argsort(-count, kind="stable")
    shares = range_coder.Frequencies.shares(count[order])
    rank = np.empty(len(used), np.uint16)
    rank[order] = np.arange(len(used))
    width = range_coder.BLOCK
    n_blocks = -(-len(ids) // width)
    blocks = np.zeros(n_blocks * width, np.uint16)
    if len(used) and used[-1] < 1 << 20:
        of_id = np.zeros(int(used[-1]) + 1, np.uint16)
        of_id[used] = rank
        of_id.take(ids, out=blocks[: len(ids)], mode="clip")
    else:
        blocks[: len(ids)] = rank[np.searchsorted(used, ids)]
    lengths = np.full(n_blocks, width)
    if n_blocks:
        lengths[-1] = len(ids) - width * (n_blocks - 1)
    blocks, coded = blocks.reshape(n_blocks, width), []
    frequencies = range_coder.Frequencies(shares)
    for a in range(0, n_blocks, range_coder.LANES):
        coded += range_coder.encode(blocks[a : a + range_coder.LANES], lengths[a : a + range_coder.LANES], frequencies)
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    sums = [zlib.crc32(raw[4 * i * width : 4 * (i + 1) * width]) for i in range(n_blocks)]
    index = np.array([lengths, [len(c) for c in coded], sums], "<u4").T.tobytes() if n_blocks else b""
    head = struct.pack("<8sQQQQ", MAGIC, len(doc_ids), len(ids), len(used), n_blocks)
    body = [head, doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), used[order].astype("<u4").tobytes(), shares.astype("<u4").tobytes(), index, *coded]
    whole = 0
    for part in body:
        whole = zlib.crc32(part, whole)
    return b"".join([*body, struct.pack("<I", whole)])


def unpack(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids) of a shard; every checksum is verified."""
    if len(image) < 44 or image[:8] != MAGIC or zlib.crc32(memoryview(image)[:-4]) != struct.unpack("<I", image[-4:])[0]:
        raise ValueError("not a whole token shard")
    n_docs, n_ids, n_used, n_blocks = struct.unpack_from("<QQQQ", image, 8)
    at = 40

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(image, dtype, n, at)
        at += found.nbytes
        return found

    doc_ids, sizes, used, shares, index = take("<i8", n_docs), take("<u4", n_docs), take("<u4", n_used), take("<u4", max(1, n_used)), take("<u4", 3 * n_blocks).reshape(-1, 3)
    coded = []
    for length in index[:, 1]:
        coded.append(memoryview(image)[at : at + int(length)])
        at += int(length)
    frequencies = range_coder.Frequencies(shares)
    lengths = index[:, 0].astype(np.int64)
    found = np.empty(int(lengths.sum()), "<u4")
    raw, done = memoryview(found).cast("B"), 0
    for a in range(0, n_blocks, range_coder.LANES):
        ranks = range_coder.decode(coded[a : a + range_coder.LANES], lengths[a : a + range_coder.LANES], frequencies)
        for i, n in enumerate(lengths[a : a + range_coder.LANES].tolist()):
            used.take(ranks[i, :n], out=found[done : done + n], mode="clip")
            if zlib.crc32(raw[4 * done : 4 * (done + n)]) != index[a + i, 2]:
                raise ValueError(f"block {a + i} of a token shard is damaged")
            done += n
    if done != n_ids:
        raise ValueError("a token shard holds another number of ids than it says")
    return doc_ids, sizes.astype(np.int64), found


def _shards(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    if len(doc_ids) > 1 and len(np.unique(ids)) > range_coder.RANKS:
        half = len(doc_ids) // 2
        cut = int(sizes[:half].sum())
        yield from _shards(doc_ids[:half], sizes[:half], ids[:cut])
        yield from _shards(doc_ids[half:], sizes[half:], ids[cut:])
    else:
        yield len(doc_ids), len(ids), pack(doc_ids, sizes, ids)


def write_shards(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode documents(doc_id, text) and write them as shards in ascending doc_id order: part, seq, n_docs, n_ids, file."""
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(pieces(documents.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = byte_level_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for n_docs, n_ids, image in _shards(np.concatenate(docs), np.concatenate(sizes), np.concatenate(ids)):
                yield pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [n_docs], "n_ids": [n_ids], "file": [image]})
                seq += 1

        for batch in batches:
            for rows in slices(batch):
                found, n = encoder.encode(*texts_of(rows.column("text")))
                if held and held + len(found) + len(n) > SHARD_IDS:
                    yield from flush()
                    docs, sizes, ids, held = [], [], [], 0
                # Each document's ids are followed by the end id.
                docs.append(rows.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
                sizes.append(n + 1)
                ids.append(np.insert(found, np.cumsum(n), np.int32(end_id)))
                held += len(found) + len(n)
        if held:
            yield from flush()

    return materialise(ordered.mapInArrow(work, "part long, seq long, n_docs long, n_ids long, file binary"), "tokens")


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `most` ids; a longer one comes alone."""
    a = 0
    while a < len(ends):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        yield a, b
        a = b


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) of every document of the shards."""
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_ids"))  # a row for each range, as many as partitions
    before = F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("_part"), before.alias("_before"))
    placed = shards.select("part", "seq", "n_ids").withColumn("_in", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).join(parts, F.col("part") == F.col("_part"))
    placed = placed.select(F.col("part").alias("_p"), F.col("seq").alias("_s"), (F.col("_in") + F.col("_before")).alias("first"))
    rows = shards.join(placed, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s"))).select("first", "file")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, sizes, ids = unpack(image.as_py())
                del image
                ends = np.cumsum(sizes)
                # Batches of about OUT_IDS ids; the binary column is a view of them.
                for a, b in _runs(ends, OUT_IDS):
                    begin = int(ends[a] - sizes[a])
                    edges = np.concatenate([[0], ends[a:b] - begin]).astype(np.int64) * 4
                    held = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(ids[begin : ends[b - 1]])])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], mask=doc_ids[a:b] == NO_ID), pa.array(first + ends[a:b] - sizes[a:b]), pa.array(sizes[a:b]), held.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_shards(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
