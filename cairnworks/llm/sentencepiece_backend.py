"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; its pieces, scores, types, trainer and normaliser settings are read here and the
tokenizer is rebuilt from them: character map, dummy prefix, metaspace marker, unigram scores (or, for a BPE
model, merges in the order of the scores) and byte fallback. Batches are encoded with `threads` threads. Every
distinct chunk that a worker meets is compared with the sentencepiece library (`parity`; models that change texts
before they encode them are compared by whole texts), and every text is decoded from its ids again (`round_trip`).
The ids are this backend's own in any case.

No piece of such a model has the marker after another character (checked when it is loaded; other models encode
whole texts), so a text may be cut before each run of markers.
Edge cases: null and empty texts have no ids and decode to ''; a text that holds the marker itself decodes to
spaces there, as in the original library; characters without a piece become byte pieces (or the unknown id
without byte fallback, and then no round trip); repeated rows are encoded alike; an empty table gives an empty
result; extra columns are ignored by `encoded` and kept by `with_ids`.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairnworks.llm.bytetext import slices, texts_of
from cairnworks.llm.chunked_encoding import ChunkEncoder
from cairnworks.llm.common import read

#: Fixed values of the format: the marker, and the types of pieces and models.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
THREADS = 2


@dataclass
class ModelFile:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> ModelFile:
    model = ModelFile()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: bytes(4), 3: NORMAL} | dict(_fields(value))
            model.pieces.append(piece[1].decode())
            model.scores.append(struct.unpack("<f", piece[2])[0])
            model.types.append(piece[3])
        elif number == 2:
            trainer = dict(_fields(value))
            model.model_type, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            normaliser = dict(_fields(value))
            model.charsmap = normaliser.get(2, b"")
            model.dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
    return model


def merges_of(model: ModelFile) -> list[tuple[str, str]]:
    """The merges of a BPE model: each normal piece from every two pieces that make it, best score first.

    Of pieces with one score the library takes the leftmost in the text. Where these are runs of one character (of
    markers, usually), that means to lengthen the run on the left again and again, so the longest left part goes first.
    """
    score = {p: s for p, s, t in zip(model.pieces, model.scores, model.types, strict=True) if t in (NORMAL, USER_DEFINED)}
    number = {p: i for i, p in enumerate(model.pieces)}
    with_score: dict[float, list[str]] = {}
    for p, s in score.items():
        with_score.setdefault(s, []).append(p)
    tied_runs = {p for same in with_score.values() if len(same) > 1 for p in same if len(p) > 1 and p == p[0] * len(p)}
    found = []
    for p, s in score.items():
        found += [(-s, -k if p in tied_runs else 0, number[p[:k]], number[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(model: ModelFile):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = model.types.index(UNKNOWN)
    if model.model_type == UNIGRAM:
        backend = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.model_type == BPE:
        vocabulary = {p: i for i, p in enumerate(model.pieces)}
        backend = models.BPE(vocabulary, merges_of(model), unk_token=model.pieces[unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    tokenizer = Tokenizer(backend)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Codec:
    """Encodes and decodes lists of texts; `different` holds chunks that the sentencepiece library encodes otherwise."""

    def __init__(self, path: str, threads: int = THREADS, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        with open(path, "rb") as file:
            self.model = parse_model(file.read())
        self.tokenizer = build_tokenizer(self.model)
        self.normalise = self.tokenizer.normalizer.normalize_str
        self.plain = not self.model.charsmap and not self.model.remove_extra_whitespaces and self.model.escape_whitespaces and self.model.dummy_prefix
        self.different: set[bytes] = set()
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cuttable = all(MARK not in p.lstrip(MARK) for p in self.model.pieces)
        self.chunks = ChunkEncoder(self._starts, self._encode_chunks, share=0.25)
        # What is encoded in chunks has been normalised as a whole before.
        self.bare = build_tokenizer(self.model)
        from tokenizers import normalizers

        self.bare.normalizer = normalizers.Sequence([])
        self.piece_bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(self.model.pieces, self.model.types, strict=True)]
        self.lengths = np.array([len(b) for b in self.piece_bytes])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.all_bytes = np.frombuffer(b"".join(self.piece_bytes), np.uint8)

    def _starts(self, data: np.ndarray) -> np.ndarray:
        """Whether a run of markers begins at a byte: of spaces, which stand for markers in plain models, or of the marker's bytes."""
        out = np.zeros(len(data), bool)
        if self.cuttable and self.plain:
            out[1:] = (data[1:] == 32) & (data[:-1] != 32)
        elif self.cuttable and len(data) > 2:
            a, b, c = MARK.encode()
            out[:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            out[3:] &= ~out[:-3].copy()
        return out

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode().replace(" ", MARK) if self.plain else c.decode() for c in chunks]
        coded = [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        if self.reference is not None and self.plain:
            # The library puts the marker before a text itself, so a chunk is shown to it without its first one.
            theirs = self.reference.encode([t[1:] for t in texts], num_threads=1)
            mark = [self.reference.piece_to_id(MARK)]
            self.different.update(c for c, t, mine, other in zip(chunks, texts, coded, theirs, strict=True) if mine != (mark if t == MARK else other))
        return np.fromiter(itertools.chain.from_iterable(coded), np.int32), np.fromiter(map(len, coded), np.int64, len(coded))

    def normalised(self, text: str) -> str:
        if not self.plain:
            return self.normalise(text) if text else ""
        return (MARK if text else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each text)."""
        shown = [" " + t.replace(MARK, " ") if t else "" for t in texts] if self.plain else [self.normalised(t) for t in texts]
        return self.chunks.encode(*texts_of(pa.array(shown, pa.large_string())))

    def parity(self, text: str) -> bool | None:
        """Whether the library encodes a text (one just encoded) alike; null if it is not asked.

        Every distinct chunk of a plain model has been compared. For other models, and once a chunk has differed,
        the whole text is.
        """
        if self.reference is None:
            return None
        return self.plain and not self.different or self.encode([text])[0].tolist() == self.reference.encode(text)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of ids in a row: pieces and byte pieces joined, markers as spaces, less the dummy prefix."""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(self.begins[ids] - (ends - length), length)
        joined = self.all_bytes[place].tobytes()
        borders = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        texts = [joined[a:b].decode("utf-8", "replace") for a, b in zip(borders[:-1], borders[1:], strict=True)]
        return [t.removeprefix(" ") for t in texts] if self.model.dummy_prefix else texts


_codecs: dict[tuple[str, int], Codec] = {}  # a worker keeps its codec, and the chunks it remembers, from task to task


def _coded(batches: Iterator[pa.RecordBatch], path: str, threads: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    if (path, threads) not in _codecs:
        _codecs.clear()
        _codecs[path, threads] = Codec(path, threads)
    codec = _codecs[path, threads]
    for batch in batches:
        for part in slices(batch):
            texts = part.column("text").fill_null("").to_pylist()
            ids, sizes = codec.encode(texts)
            ends = np.cumsum(sizes)
            back = codec.decode(ids, sizes)
            expected = [t.replace(MARK, " ") for t in texts] if codec.plain else [codec.normalised(t).replace(MARK, " ").removeprefix(" ") for t in texts]
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
            sums = [zlib.crc32(ids[e - n : e].astype("<u4")) for e, n in zip(ends, sizes, strict=True)]
            columns = [pa.array(sizes, pa.int64()), listed, pa.array(sums, pa.int64()), pa.array([a == b for a, b in zip(back, expected, strict=True)]), pa.array([codec.parity(t) for t in texts])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], [*keep, "n_tokens", "ids", "ids_crc32", "round_trip", "parity"])


ADDED = "n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean, parity boolean"


def encoded(documents: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_tokens, ids, ids_crc32, round_trip, parity."""
    rows = documents.select(documents["doc_id"].cast("long"), "text")
    return rows.mapInArrow(lambda batches: _coded(batches, path, threads, ["doc_id"]), f"doc_id long, {ADDED}")


def with_ids(documents: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """documents with all columns but those that are added here."""
    new = ("n_tokens", "ids", "ids_crc32", "round_trip", "parity")
    rows = documents.drop(*new)
    keep = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda batches: _coded(batches, path, threads, keep), f"{schema}, {ADDED}")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
