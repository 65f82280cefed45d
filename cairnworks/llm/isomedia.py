"""ISO media containers in a binary column: walk nested boxes, decode sample tables, list keyframe byte ranges.

`index_media` never decodes a payload: it reads box headers and sample tables and returns codec, duration,
sample count and the byte ranges of keyframes. `store_samples` writes bytes as the 8-bit samples of a small
container, `stored_bytes` reads them back through the sample tables. Of a file with several tracks the first video
track is indexed, or else the first one.

Edge cases: a null value, or bytes that are no container, are cut off or are fragmented, index to nulls (and no ranges);
an empty payload has no samples; unknown boxes are skipped; a 64-bit or open-ended box size is followed;
repeated rows give repeated results; an empty table an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairnworks.llm.common import read

#: Fixed values of the container format: boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}
UNIT = 192  # bytes of a sample (an access unit)
PER_CHUNK = 64  # samples of a chunk
KEY_EVERY = 16  # every so many samples is a keyframe
RATE = 8000  # ticks a second; one byte lasts one tick


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, bytes(4), *parts)


def store_samples(payload: bytes) -> bytes:
    """A container with one 8-bit PCM track whose samples are `payload` in units of UNIT bytes; a multiple is asked for."""
    n, rest = divmod(len(payload), UNIT)
    if rest:
        raise ValueError(f"payload of {len(payload)} bytes is no multiple of {UNIT}")
    chunks, last = -(-n // PER_CHUNK), n % PER_CHUNK or PER_CHUNK
    runs = [(1, PER_CHUNK if chunks > 1 else last, 1)] * bool(n) + [(chunks, last, 1)] * (chunks > 1 and last != PER_CHUNK)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    ticks, head = len(payload), _box(b"ftyp", b"qt  ", bytes(4), b"qt  isom")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

    def movie(first: int) -> bytes:
        starts = (first + np.arange(chunks, dtype=np.int64) * PER_CHUNK * UNIT).astype(">u8").tobytes()
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT) if n else struct.pack(">I", 0)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"co64", struct.pack(">I", chunks), starts),
        )
        info = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", struct.pack(">I", 1)))), table)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, ticks, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(13)), info)
        track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhh", 0, 0, 256, 0), matrix, bytes(8))
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, ticks, 0x10000, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), _box(b"trak", track, media))

    first = len(head) + len(movie(0)) + 16
    return head + movie(first) + struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) + payload


def boxes(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, nested ones after the box that holds them."""
    while start + 8 <= end:
        length, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if length == 1:
            (length,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if length == 0 else start + length
        if stop > end or stop < body:
            raise ValueError("cut off or malformed box")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from boxes(data, body, stop, (*path, kind))
        start = stop


def tracks(view: memoryview) -> list[dict[bytes, tuple[int, int]]]:
    """The first box of each kind of every track, by kind."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, body, stop in boxes(view, 0, len(view)):
        if path == (b"moof",):
            raise ValueError("fragmented files keep their sample tables in fragments, which are not read")
        if path == (b"moov", b"trak"):
            found.append({})
        if path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (body, stop))
    return found


def sample_tables(data: bytes) -> dict:
    """Of the first video track, or else of the first one: codec, timescale, duration, and arrays of each sample's offset, size and whether it is a keyframe."""
    view = memoryview(data)
    every = tracks(view)
    if not every:
        raise ValueError("no track")
    video = [t for t in every if b"hdlr" in t and bytes(view[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]) == b"vide"]
    found = (video or every)[0]

    def numbers(kind: bytes, skip: int, dtype: str, count: int) -> np.ndarray:
        body, stop = found[kind]
        if body + skip + count * np.dtype(dtype).itemsize > stop:
            raise ValueError("cut off table")
        return np.frombuffer(view, dtype, count, body + skip)

    def word(kind: bytes, at: int) -> int:
        return struct.unpack_from(">I", view, found[kind][0] + at)[0]

    wide = view[found[b"mdhd"][0]] == 1
    timescale, duration = struct.unpack_from(">IQ" if wide else ">II", view, found[b"mdhd"][0] + (20 if wide else 12))
    n, fixed = word(b"stsz", 8), word(b"stsz", 4)
    sizes = np.full(n, fixed, np.int64) if fixed else numbers(b"stsz", 12, ">u4", n).astype(np.int64)
    chunk_kind, chunk_type = (b"co64", ">u8") if b"co64" in found else (b"stco", ">u4")
    chunk_starts = numbers(chunk_kind, 8, chunk_type, word(chunk_kind, 4)).astype(np.int64)
    runs = numbers(b"stsc", 8, ">u4", 3 * word(b"stsc", 4)).reshape(-1, 3).astype(np.int64)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk_starts) + 1)))
    chunk_of = np.repeat(np.arange(len(chunk_starts)), per_chunk)[:n]
    if len(chunk_of) != n:
        raise ValueError("chunks hold fewer samples than the size table")
    ends = np.cumsum(sizes)
    firsts = np.concatenate([[0], np.cumsum(per_chunk)[:-1]]) if len(per_chunk) else np.zeros(0, np.int64)
    before = np.concatenate([[0], ends])[firsts] if len(firsts) else firsts
    offsets = chunk_starts[chunk_of] + (ends - sizes) - before[chunk_of]
    if n and (offsets + sizes).max() > len(view):
        raise ValueError("samples lie outside the file")
    key = np.ones(n, bool)
    if b"stss" in found:
        key = np.zeros(n, bool)
        key[numbers(b"stss", 8, ">u4", word(b"stss", 4)).astype(np.int64) - 1] = True
    return {"codec": bytes(view[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1"), "timescale": timescale, "duration": duration, "offsets": offsets, "sizes": sizes, "key": key}


def stored_bytes(data: bytes, tables: dict) -> bytes:
    """All samples in order; neighbours are read in one piece."""
    offsets, sizes = tables["offsets"], tables["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    begin, end = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(offsets)]])
    return b"".join(data[offsets[a] : offsets[b - 1] + sizes[b - 1]] for a, b in zip(begin, end, strict=True))


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))


def keyframes_of(tables: dict) -> list[dict]:
    """The byte ranges of the keyframes."""
    at = np.flatnonzero(tables["key"])
    return [{"start": a, "size": b} for a, b in zip(tables["offsets"][at].tolist(), tables["sizes"][at].tolist(), strict=True)]


INDEX_SCHEMA = "codec string, duration_s double, n_samples long, keyframes array<struct<start:long,size:long>>"


def index_media(media: DataFrame, key: str, column: str) -> DataFrame:
    """media(key, column binary) -> key, codec, duration_s, n_samples, keyframes; payloads are not touched."""
    kind = media.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", RANGES)])
        for batch in batches:
            rows = []
            for value in batch.column(1):
                try:
                    t = sample_tables(value.as_buffer().to_pybytes() if value.is_valid else b"")
                    rows.append({"codec": t["codec"], "duration_s": t["duration"] / t["timescale"] if t["timescale"] else None, "n_samples": len(t["sizes"]), "keyframes": keyframes_of(t)})
                except (KeyError, ValueError, struct.error, IndexError):
                    rows.append(dict.fromkeys(schema.names))
            out = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], [key, *schema.names])

    return media.select(key, column).mapInArrow(work, f"`{key}` {kind}, {INDEX_SCHEMA}")


def describe(tables: dict, payload: bytes) -> str:
    """A short feature string: codec, seconds, samples, keyframes, mean and a 16-bin histogram of the sample values."""
    values = np.frombuffer(payload, np.uint8)
    histogram = np.bincount(values >> 4, minlength=16)
    return f"{tables['codec']}/{tables['duration'] / tables['timescale']:.6f}s/{len(tables['sizes'])}/{int(tables['key'].sum())}/{values.mean() if len(values) else 0:.6f}/" + ",".join(map(str, histogram))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "keyframe_bytes", "keyframes"]
    for batch in batches:
        rows = []
        for text in batch.column(1):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            media = store_samples(raw + b" " * (-len(raw) % UNIT if raw else UNIT))
            tables = sample_tables(media)
            back = stored_bytes(media, tables)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(tables, back), int(tables["sizes"][tables["key"]].sum()), keyframes_of(tables)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), RANGES]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the samples of a container, read back through its boxes and tables, and digested."""
    return read(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(
        _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframe_bytes long, keyframes array<struct<start:long,size:long>>"
    )
