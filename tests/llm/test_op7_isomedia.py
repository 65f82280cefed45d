import hashlib
import struct
import zlib

import numpy as np
import pytest

from cairnworks.llm import isomedia


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 500])
def test_samples_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n * isomedia.UNIT, dtype=np.uint8).tobytes()
    media = isomedia.store_samples(payload)
    tables = isomedia.sample_tables(media)
    assert isomedia.stored_bytes(media, tables) == payload
    assert (tables["codec"], tables["duration"], tables["timescale"]) == ("raw ", len(payload), isomedia.RATE)
    keys = np.flatnonzero(tables["key"])
    assert keys.tolist() == list(range(0, n, isomedia.KEY_EVERY))
    for k in keys:
        assert media[tables["offsets"][k] :][: isomedia.UNIT] == payload[k * isomedia.UNIT :][: isomedia.UNIT]


def test_other_layouts_are_read():
    """32-bit offsets, sizes one by one, an unknown box, an open-ended mdat, chunks out of order, and no keyframe table."""
    box, full = isomedia._box, isomedia._full
    body = b"BBBAACCCC"
    stbl = lambda at: box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"mp4a", bytes(28))), full(b"stsz", struct.pack(">IIIII", 0, 3, 2, 3, 4)), full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)), full(b"stco", struct.pack(">IIII", 3, at + 3, at, at + 5)))
    mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 2500, 0, 0))
    moov = lambda at: box(b"moov", box(b"free", b"junk"), box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl(at)))))
    head = box(b"ftyp", b"isom")
    at = len(head) + len(moov(0)) + 8
    media = head + moov(at) + struct.pack(">I4s", 0, b"mdat") + body
    tables = isomedia.sample_tables(media)
    assert isomedia.stored_bytes(media, tables) == b"AABBBCCCC" and tables["key"].all() and tables["duration"] == 2500


def test_index_of_odd_media(spark):
    good = isomedia.store_samples(bytes(range(192)) * 20)
    values = [good, None, b"", b"junk that is no container", good[:100], good[:-10], good]
    frame = spark.createDataFrame([(i, bytearray(v) if v is not None else None, "x") for i, v in enumerate(values)], "id long, media binary, codec string")
    rows = {r["id"]: r for r in isomedia.index_media(frame, "id", "media").collect()}
    assert rows[0]["codec"] == "raw " and rows[0]["n_samples"] == 20 and [k["size"] for k in rows[0]["keyframes"]] == [192, 192] and abs(rows[0]["duration_s"] - 0.48) < 1e-9
    assert all(rows[i]["codec"] is None and rows[i]["keyframes"] is None for i in range(1, 6)) and rows[6][1:] == rows[0][1:]
    assert isomedia.index_media(frame.limit(0), "id", "media").count() == 0


def test_query(spark, documents, odd, empty):
    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframe_bytes long"
    for frame in (documents, odd):
        texts = {}
        for r in frame.collect():
            texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
        rows = frame.select("doc_id", "text").mapInArrow(isomedia._digests, columns).collect()
        assert len(rows) == frame.count()
        for r in rows:
            if len(texts[r["doc_id"]]) > 1:
                continue
            raw = next(iter(texts[r["doc_id"]])).encode()
            payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert empty.select("doc_id", "text").mapInArrow(isomedia._digests, columns).count() == 0


def test_the_video_track_of_two_is_indexed():
    """An audio track without a sync table before a video track with one: codec, sizes and keyframes are the video's."""
    audio, video = isomedia.store_samples(bytes(192 * 3)), isomedia.store_samples(bytes(192 * 40))
    at = lambda data, kind: next((b - 8, e) for p, b, e in isomedia.boxes(memoryview(data), 0, len(data)) if p == kind)
    (a, b), (c, d) = at(audio, (b"moov", b"trak")), at(video, (b"moov", b"trak"))
    sound, picture = audio[a:b].replace(b"stss", b"free"), video[c:d].replace(b"soun", b"vide")
    moov_start, moov_end = at(video, (b"moov",))
    body = video[moov_start + 8 : c] + sound + picture
    shift = len(sound)
    first = int.from_bytes(picture[picture.index(b"co64") + 12 : picture.index(b"co64") + 20], "big")
    both = video[:moov_start] + isomedia._box(b"moov", body.replace(picture, picture.replace(first.to_bytes(8, "big"), (first + shift).to_bytes(8, "big")))) + video[moov_end:]
    tables = isomedia.sample_tables(both)
    assert len(tables["sizes"]) == 40 and np.flatnonzero(tables["key"]).tolist() == [0, 16, 32] and tables["offsets"][0] == first + shift


def test_query_lists_keyframes(spark):
    rows = isomedia.op7_media(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        media = isomedia.store_samples(raw + b" " * (-len(raw) % 192 if raw else 192))
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        n = r["payload_bytes"] // 192
        first = len(media) - r["payload_bytes"]
        assert [(k["start"], k["size"]) for k in r["keyframes"]] == [(first + i * 192, 192) for i in range(0, n, 16)]
        assert r["feature"].startswith(f"raw /{r['payload_bytes'] / 8000:.6f}s/{n}/{-(-n // 16)}/")
