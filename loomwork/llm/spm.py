"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message; its wire format is read here field by field. From it come the normaliser (the
precompiled character map, extra white space, the dummy prefix), the white-space marker, the pieces with their scores
(a unigram model, or for a pair-encoding model the merges in the order of the scores) and byte fallback.

No piece holds a marker after another character (this is checked), so a text's encoding is that of its chunks, each a run
of markers and what follows up to the next one. A batch encodes each distinct chunk once, in the task's own thread,
and maps every chunk to its ids. Each distinct chunk's ids are decoded by the rebuilt decoder and compared with the chunk
and, where the sentencepiece library is asked to confirm parity, with that library's ids. A chunk begins with a marker,
which ends any run of byte pieces, so a text's decoding is that of its chunks too.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from loomwork.llm.common import map_texts, text_pieces

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format: fields of the messages and kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text that a batch works on together.
PIECE = 1 << 20
#: Distinct chunks that a worker remembers before it begins anew, about 0.2 KB each; of 0.5 million in 25 MB of text most come again only far on.
CACHE = 300_000
#: New chunks that are encoded together; the libraries hold about 1 KB for each.
LEARN = 4096
#: One in so many distinct chunks, by hash, is compared with the sentencepiece library (0: none; 1: all).
PARITY = 1
CHUNK = re.compile(" +[^ ]*")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: numbers, or bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"not a model file: wire type {kind}")
        yield key >> 3, value


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(raw):
            if field == PIECES:
                x = dict(_fields(value))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be rebuilt")
        if any(k == USER for _, _, k in self.pieces):
            raise ValueError("models with user-defined symbols cannot be rebuilt")
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in self.pieces if k == NORMAL)

    def merges(self) -> list[tuple[str, str]]:
        """All pairs of pieces that make a piece, by its score, best first."""
        ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        found = []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in ids and b in ids:
                    found.append((-self.pieces[i][1], i, ids[a], ids[b], a, b))
        return [(x[4], x[5]) for x in sorted(found)]

    def core(self) -> models.Model:
        unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        if self.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in self.pieces], unknown, self.byte_fallback)
        vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        return models.BPE(vocab=vocabulary, merges=self.merges(), unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)

    def tokenizer(self, core: models.Model | None = None) -> Tokenizer:
        """A tokenizer of the model; those that are given one core share its tables."""
        out = Tokenizer(core or self.core())
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        if self.splits:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if self.dummy_prefix else back)
        return out


def read_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file, by Spark's reader where the driver cannot open the path."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


class Codec:
    """Encoding and decoding of batches. Without splits, or with a normaliser that changes characters, whole texts are encoded."""

    def __init__(self, raw: bytes, parity: int = 0) -> None:
        self.parity = parity
        self.model = Model(raw)
        core = self.model.core()
        self.tokenizer = self.model.tokenizer(core)
        self.chunked = self.model.splits and not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix
        self.bare = self.model.tokenizer(core)
        self.bare.normalizer = self.bare.pre_tokenizer = None
        self.pieces = self.model.tokenizer(core)  # decodes what is not the beginning of a text
        self.pieces.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.forget()
        self.other = None
        if parity:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        exact = [a == b for a, b in zip(texts, back, strict=True)]
        same = [True] * len(texts) if self.other is None else [a == b for a, b in zip(ids, self.other.encode(texts), strict=True)]
        return ids, exact, same

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bool, bool]]:
        """(ids, whether they decode to the text, whether the sentencepiece library agrees) of each text."""
        texts = [t or "" for t in texts]
        for at, to in text_pieces(texts, PIECE):
            part = texts[at:to]
            if not self.chunked:
                for ids, exact, same in zip(*self._encode(part), strict=True):
                    yield np.asarray(ids, np.int32), exact, same
                continue
            if len(self.number) > CACHE:
                self.forget()
            number, known = self.number, len(self.number)
            rows = [[number.setdefault(c, len(number)) for c in CHUNK.findall(" " + t)] if t else [] for t in part]
            self.learn(list(islice(reversed(number), len(number) - known))[::-1])
            found = []
            for row in rows:
                chunk = np.array(row, np.int64)
                n = self.lengths[chunk]
                where = np.repeat(self.starts[chunk] - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append((self.flat[where], bool(self.exact[chunk].all()), bool(self.same[chunk].all())))
            yield from found

    def forget(self) -> None:
        """Empty the table of chunks."""
        self.number: dict[str, int] = {}
        self.lengths, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.exact, self.same = np.zeros(0, bool), np.zeros(0, bool)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks at the end of the table, LEARN together. A chunk without its first space is a text whose dummy prefix is that space."""
        if not chunks:
            return
        parts = [self._learned(chunks[k : k + LEARN]) for k in range(0, len(chunks), LEARN)]
        # the table is copied once for all that is new
        lengths, flat, exact, same = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])
        self.exact, self.same = np.concatenate([self.exact, exact]), np.concatenate([self.same, same])

    def _learned(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some chunks: how many ids each has, the ids, whether they decode to it, and whether the sentencepiece library agrees."""
        marked = [c.replace(" ", MARK) for c in chunks]
        found = [x.ids for x in self.bare.encode_batch_fast(marked, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, lengths.sum())
        exact = [x == c for c, x in zip(chunks, self.pieces.decode_batch(found, skip_special_tokens=False), strict=True)]
        same = [True] * len(chunks)
        if self.other is not None:
            asked = [i for i, c in enumerate(chunks) if c != " " and zlib.crc32(c.encode("utf-8", "replace")) % self.parity == 0]
            for i, x in zip(asked, self.other.encode([chunks[i][1:] for i in asked], num_threads=1), strict=True):
                same[i] = x == found[i]
        return lengths, flat, np.array(exact, bool), np.array(same, bool)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def _codec(raw: bytes, parity: int) -> Codec:
    # every core has a task; the library's threads would only wait for them, and each keeps memory for as long as the worker lives
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Codec(raw, parity)


def encode(docs: DataFrame, path: str = MODEL, parity: int = PARITY, text: str = "text") -> DataFrame:
    """docs with token_ids (array<int>), n_tokens, round_trip and same_as_sentencepiece.

    Columns of these names are replaced. Null and empty texts have no tokens; repeated rows each give a row; an empty
    table gives none. round_trip says that the ids decode to the text itself; same_as_sentencepiece that no compared chunk of it differs.
    """
    raw = read_model(docs.sparkSession, path)
    new = {"token_ids": "array<int>", "n_tokens": "int", "round_trip": "boolean", "same_as_sentencepiece": "boolean"}
    kept = [c for c in docs.columns if c.lower() not in new]

    def make():
        codec = _codec(raw, parity)
        def values(texts: list[str | None]) -> dict:
            found = list(codec.encode(texts))
            return {"token_ids": [x[0] for x in found], "n_tokens": [len(x[0]) for x in found], "round_trip": [x[1] for x in found], "same_as_sentencepiece": [x[2] for x in found]}

        values.done = codec.forget  # the worker lives on, its table need not
        return values

    return map_texts(docs, text, make, ", ".join(f"{k} {v}" for k, v in new.items()), kept)


def decode(rows: DataFrame, path: str = MODEL, ids: str = "token_ids") -> DataFrame:
    """rows with `decoded`, the text of the ids; null ids give null."""
    raw = read_model(rows.sparkSession, path)

    def text(column: pd.Series) -> pd.Series:
        codec = _codec(raw, 0)
        known = [i for i, x in enumerate(column) if x is not None]
        out = [None] * len(column)
        for i, x in zip(known, codec.decode([list(map(int, column.iloc[i])) for i in known]), strict=True):
            out[i] = x
        return pd.Series(out, dtype=object)

    return rows.withColumn("decoded", F.pandas_udf(text, "string")(F.col(ids)))


def summary(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip, same_as_sentencepiece of each row of docs (doc_id, text)."""
    raw = read_model(docs.sparkSession, path)

    def make():
        codec = _codec(raw, PARITY)

        def values(texts: list[str | None]) -> dict:
            out = [(len(i), hashlib.sha256(i.astype("<i4").tobytes()).hexdigest(), e, s) for i, e, s in codec.encode(texts)]
            return {name: [x[k] for x in out] for k, name in enumerate(("n_tokens", "ids_sha256", "round_trip", "same_as_sentencepiece"))}

        values.done = codec.forget  # the worker lives on, its table need not
        return values

    return map_texts(docs, "text", make, "n_tokens int, ids_sha256 string, round_trip boolean, same_as_sentencepiece boolean", ["doc_id"])
