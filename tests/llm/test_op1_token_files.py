import zlib

import numpy as np
import pytest

from cairnworks.llm import range_coder, token_files

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_blocks_round_trip():
    rng = np.random.default_rng(6)
    kinds = [rng.zipf(1.3, 3000) % 65536, rng.integers(0, 65536, 3000), np.zeros(3000, int), np.tile(np.arange(7), 429)[:3000], np.full(3000, 65535)]
    blocks, sizes = np.stack(kinds), np.array([3000, 3000, 2999, 7, 0])
    coded = range_coder.encode(blocks, sizes)
    back = range_coder.decode(coded, sizes)
    assert all((back[i, :n] == blocks[i, :n]).all() for i, n in enumerate(sizes))
    assert len(coded[2]) < 400 and len(coded[0]) < 2 * 3000  # what can be predicted is short
    alone = range_coder.decode([coded[1]], sizes[1:2])  # a block needs no other one
    assert (alone[0] == blocks[1]).all()


def test_shards_round_trip_and_damage():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 900, 40)
    ids = rng.integers(0, 50257, sizes.sum()).astype(np.uint32)
    image = token_files.pack(np.arange(40), sizes, ids)
    docs, n, back = token_files.unpack(image)
    assert (docs == np.arange(40)).all() and (n == sizes).all() and (back == ids).all()
    for at in (0, 20, len(image) // 2, len(image) - 1):
        broken = bytearray(image)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack(bytes(broken))
    with pytest.raises(ValueError):
        token_files.unpack(image[:-7])
    assert [len(x) for x in token_files.unpack(token_files.pack(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)))] == [0, 0, 0]


def expected(docs, path):
    tokenizer = tokenizers.Tokenizer.from_file(path)
    at, out = 0, []
    for d, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_documents(spark, documents):
    path = public.path("byte_bpe_50k.json")
    docs = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    rows = token_files.read_shards(token_files.write_shards(documents.repartition(3), path)).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows) == expected(docs, path)


def test_odd_rows_and_white_space(odd, empty, spark):
    path = public.path("byte_bpe_50k.json")
    docs = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    rows = token_files.read_shards(token_files.write_shards(odd, path)).collect()
    assert sorted(map(str, ((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows))) == sorted(map(str, expected(docs, path)))
    assert token_files.read_shards(token_files.write_shards(empty, path)).count() == 0
    spaces = [" a", "a ", "  a  b\n\n c", "a\u00a0 b", "a\u00a0\n\u00a0b", "\u3000 \u3000x", "\t\n", "a\x1c \x85b", "it's  we'll\n'd", "1 22  333", "\u2003a \u2003 b"]
    frame = spark.createDataFrame(list(enumerate(spaces)), "doc_id long, text string")
    rows = token_files.read_shards(token_files.write_shards(frame, path)).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows) == expected(list(enumerate(spaces)), path)
