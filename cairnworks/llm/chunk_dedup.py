"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash runs over the bytes of each text; a chunk ends before a word where the hash has zeros in its cut
bits (one word in four; after MAX_WORDS words in any case), so an insertion moves no later chunk border. A
window is a row of consecutive chunks of one text that has at least MIN_WORDS words. Of all windows with one digest
the first, in ascending order of (doc_id, position), stays; the chunks of a later one are cut out. So short common
phrases stay, and so do chunks that each stand somewhere else but never stood together. That is the rule of the
query and the pipeline (`together`); the older one cuts any run of repeated chunks that has MIN_WORDS words.

Scale: each task first combines its own chunks and windows (the first of each digest goes to the digest's bucket,
the rest is known to repeat), so a passage in a third of all documents costs a bucket one entry a task. They travel packed.

Digests have 96 bits, for a false match would delete text, and a point that each session draws, so that no text can be made to match.

Edge cases: null and empty texts, and texts without words, pass unchanged; rows that share a doc_id come in the order
of their texts' hashes, and rows without one last; of equal rows any comes first; a text that repeats as a whole is
left empty (null texts stay null); an empty table gives an empty result; extra columns are kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.llm.bytetext import digests_of, slices, spans, texts_of
from cairnworks.llm.common import digest_key, free_names, materialise, pieces, read

CUT_BITS, CUT_SHIFT = 2, 13
MAX_WORDS = 64
MIN_WORDS = 16
WARM = 32  # bytes of a text before the hash is its own
#: Bytes of text that are worked on at once: chunks take several numbers for each byte.
SLICE = 1 << 18
#: A task combines and sends its chunks whenever it holds so many.
HOLD = 400_000
_GEAR = np.random.default_rng(31).integers(0, 2**32, 256, dtype=np.uint32)
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
_DIGEST = np.dtype([("digest", "<u8"), ("second", "<u4")])
_CHUNK = np.dtype([("digest", "<u8"), ("second", "<u4"), ("row", "<i8"), ("place", "<u4")])


def _planes(values: np.ndarray) -> bytes:
    """Integers as planes of their bytes, of which the upper ones are mostly alike and compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(blob, kind: str) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + G[data[i]] in 32 bits, for all positions at once by doubling the window."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def chunks(data: np.ndarray, offsets: np.ndarray, key: int | None = None) -> dict[str, np.ndarray]:
    """Of every chunk: row, place in its text, byte range, number of words and, with a key, both halves of its digest."""
    start, end, row = spans(data, offsets)
    if not len(start):
        return {k: np.zeros(0, np.uint64 if k in ("digest", "second") else np.int64) for k in ("row", "place", "start", "end", "digest", "second", "words")}
    hashed = gear(data)
    cut = (start - offsets[row] >= WARM) & ((hashed[start - 1] >> np.uint32(CUT_SHIFT)) & np.uint32((1 << CUT_BITS) - 1) == 0)
    cut[0] = True
    cut[1:] |= row[1:] != row[:-1]
    order = np.arange(len(start))
    cut |= (order - np.maximum.accumulate(np.where(cut, order, 0))) % MAX_WORDS == 0
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(start)) - 1
    new_text = np.concatenate([[True], row[first][1:] != row[first][:-1]])
    number = np.arange(len(first))
    place = number - np.maximum.accumulate(np.where(new_text, number, 0))
    digest, second = (digests_of(k).of_bytes(data, start[first], end[last], exact=True) for k in (key, key + 1)) if key is not None else (None, None)
    return {"row": row[first], "place": place, "start": start[first], "end": end[last], "digest": digest, "second": second, "words": last - first + 1}


def windows(found: dict[str, np.ndarray], min_words: int, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first chunk, number of chunks, digest) of each chunk's shortest windows of min_words words that start or end with it.

    These do for all: a chunk of a longer repeated window lies in one of them inside that window.
    """
    row, n = found["row"], len(found["row"])
    if not n:
        return _NONE
    before = np.concatenate([[0], np.cumsum(found["words"])])
    order = np.arange(n)
    stop = np.searchsorted(before, before[:-1] + min_words)
    starting = (stop <= n) & (row[np.minimum(stop, n) - 1] == row)
    start = np.searchsorted(before, before[1:] - min_words, "right") - 1
    ending = (start >= 0) & (row[np.maximum(start, 0)] == row)
    ending &= stop[np.maximum(start, 0)] != order + 1  # else it is a window that starts with its first chunk
    first = np.concatenate([order[starting], start[ending]])
    size = np.concatenate([stop[starting] - order[starting], order[ending] + 1 - start[ending]])
    return first, size, digests_of(key).of_rows(found["digest"], first, size)


def repeated_chunks(documents: DataFrame, row: str, min_words: int = MIN_WORDS, together: bool = False) -> DataFrame:
    """(row, places) of the chunks, and if `together` of the windows, that are not the first of their digest; row is a unique ascending long.

    A place is the first chunk's times min_words + 1, plus a window's number of chunks (at most min_words), or 0 for a chunk.
    """
    n_buckets = 8 * pieces(documents.sparkSession)
    key = digest_key(documents.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def combined() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["place"], rows["row"], rows["second"], rows["digest"]))]
            later = np.concatenate([[False], (rows["digest"][1:] == rows["digest"][:-1]) & (rows["second"][1:] == rows["second"][:-1])])
            bucket = np.where(later, rows["row"] % n_buckets, (rows["digest"] % np.uint64(n_buckets)).astype(np.int64)) * 2 + later
            order = np.lexsort((rows["place"], rows["row"], bucket))
            rows, bucket = rows[order], bucket[order]
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            columns = [[], [], []]
            for a, b in zip(begin, [*begin[1:], len(rows)], strict=True):
                part = rows[a:b]
                columns[0].append(b"" if bucket[a] % 2 else part[["digest", "second"]].astype(_DIGEST).tobytes())
                columns[1].append(_planes(np.diff(part["row"], prepend=0)))
                columns[2].append(_planes(part["place"]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[begin], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "digest", "row", "place"])

        for batch in batches:
            for part in slices(batch, size=SLICE):
                found = chunks(*texts_of(part.column("text")), key)
                first, n, digest = windows(found, min_words, key) if together else _NONE
                made = np.empty(len(found["row"]) + len(first), _CHUNK)
                made["digest"] = np.concatenate([found["digest"], digest])
                made["second"] = np.concatenate([found["second"], digests_of(key + 1).of_rows(found["second"], first, n)]) >> np.uint64(32)
                made["place"] = np.concatenate([found["place"] * (min_words + 1), found["place"][first] * (min_words + 1) + n])
                made["row"] = part.column("row").to_numpy()[np.concatenate([found["row"], found["row"][first]])]
                held.append(made)
                size += len(made)
                if size >= HOLD:
                    yield combined()
                    held, size = [], 0
        if size:
            yield combined()

    def gather(table: pa.Table) -> pa.Table:
        """Bucket 2k + 1 holds chunks known to repeat; bucket 2k one chunk of each digest and task, of which the first stays."""
        rows = np.concatenate([np.cumsum(_from_planes(x.as_buffer(), "<i8")) for x in table.column("row")])
        places = np.concatenate([_from_planes(x.as_buffer(), "<u4") for x in table.column("place")])
        if table.column("bucket")[0].as_py() % 2 == 0:
            digests = np.concatenate([np.frombuffer(x.as_buffer(), _DIGEST) for x in table.column("digest")])
            order = np.lexsort((places, rows, digests["second"], digests["digest"]))
            later = np.concatenate([[False], digests[order][1:] == digests[order][:-1]])
            rows, places = rows[order][later], places[order][later]
        order = np.argsort(rows, kind="stable")
        rows, places = rows[order], places[order].astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
        listed = pa.ListArray.from_arrays(pa.array(np.append(begin, len(rows)), pa.int32()), pa.array(places, pa.int32()))
        return pa.table({"row": pa.array(rows[begin], pa.int64()), "places": listed})

    packed = documents.select(F.col(row).alias("row"), "text").mapInArrow(emit, "bucket long, digest binary, row binary, place binary")
    some = packed.groupBy("bucket").applyInArrow(gather, "row long, places array<int>")
    return some.groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"))


REPORT = "struct<n_words:long,n_chunks:long,repeated_chunks:long,removed_words:long,removed:array<struct<start:int,end:int>>>"


def deduplicated(documents: DataFrame, min_words: int = MIN_WORDS, together: bool = False, report: str = "_cut") -> DataFrame:
    """documents with repeated passages cut out of `text`, all other columns kept, and a struct column `report` (REPORT), in place of one of that name.

    together: what is cut stood before as min_words words in a row, not as chunks in different places. `removed` lists code point ranges of the original text.
    """
    min_words = max(1, min_words)
    documents = documents.drop(report)
    row, of, listed_in = free_names(documents, "_row", "_of", "_places")
    unique = documents.agg((F.count("*") == F.count_distinct("doc_id"))).first()[0]
    if unique:
        numbered = documents.withColumn(row, F.col("doc_id").cast("long"))
    else:
        # A total order of all rows: the numbers given to the sorted partitions ascend with it.
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col(row)]
        rows = documents.withColumn(row, F.monotonically_increasing_id()).orderBy(*order)
        numbered = materialise(rows.withColumn(row, F.monotonically_increasing_id()), "numbered")
    places = repeated_chunks(numbered, row, min_words, together).select(F.col("row").alias(of), F.col("places").alias(listed_in))
    joined = numbered.join(places, F.col(row) == F.col(of), "left").drop(row, of)
    columns = documents.columns
    wide = min_words + 1
    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kind = pa.struct([("n_words", pa.int64()), ("n_chunks", pa.int64()), ("repeated_chunks", pa.int64()), ("removed_words", pa.int64()), ("removed", spans_kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                data, offsets = texts_of(part.column("text"))
                found = chunks(data, offsets)
                repeated = np.zeros(len(found["row"]), bool)
                edges = np.zeros(len(repeated) + 1, np.int64)
                begin = np.searchsorted(found["row"], np.arange(part.num_rows + 1))
                listed = part.column(listed_in)
                for i in np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False)):
                    place = np.asarray(listed[i].values).view(np.uint32).astype(np.int64)
                    first, n = begin[i] + place // wide, place % wide
                    repeated[first[n == 0]] = True
                    np.add.at(edges, first, (n > 0).astype(np.int64))
                    np.subtract.at(edges, first + n, (n > 0).astype(np.int64))
                if together:
                    cut = np.cumsum(edges)[:-1] > 0  # chunks that a repeated window covers
                else:
                    # Runs of repeated chunks within a text, and their words.
                    edge = np.ones(len(repeated), bool)
                    edge[1:] = (repeated[1:] != repeated[:-1]) | (found["row"][1:] != found["row"][:-1])
                    run = np.cumsum(edge) - 1
                    long_enough = np.bincount(run, found["words"]) >= min_words if len(run) else np.zeros(0, bool)
                    cut = repeated & long_enough[run] if len(run) else repeated
                texts = part.column("text").to_pylist()
                reports = []
                for i in range(part.num_rows):
                    a, b = begin[i], begin[i + 1]
                    mine = cut[a:b]
                    spans_out = []
                    if mine.any():
                        mine_bytes = data[offsets[i] : offsets[i + 1]]
                        raw, kept, at = mine_bytes.tobytes(), [], 0
                        points = np.concatenate([[0], np.cumsum((mine_bytes & 0xC0) != 0x80)])  # code points before each byte
                        # A chunk ends where the next one starts, the last one at the end of the text.
                        borders = np.append(found["start"][a:b] - offsets[i], len(raw))
                        ends = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(int)))
                        for x, y in ends.reshape(-1, 2):
                            kept.append(raw[at : borders[x]])
                            at = borders[y]
                            spans_out.append({"start": int(points[borders[x]]), "end": int(points[at])})
                        texts[i] = (b"".join(kept) + raw[at:]).decode()
                    words = found["words"][a:b]
                    reports.append({"n_words": int(words.sum()), "n_chunks": int(b - a), "repeated_chunks": int(repeated[a:b].sum()), "removed_words": int(words[mine].sum()), "removed": spans_out})
                arrays = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(reports, kind)], [*columns, report])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields) + f", `{report}` {REPORT}"
    return joined.mapInArrow(work, schema)


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"), together=True).select("doc_id", "text", "_cut.*")
