"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

Every byte maps to one printable character, so each vocabulary entry becomes a piece
whose score is its negative rank; the model is serialised field by field with an
identity normaliser. Sentencepiece merges the adjacent pair of the highest score, that
is of the lowest rank, which is what the rank file asks for. Pre-tokens come from the
file's pattern; many of them are encoded in one string, parted by a character that is no
piece, and each is then found in a bounded table.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean_batches, release_memory

#: Pre-tokens that a Python worker keeps with their ids, and their characters; beyond either the table starts anew.
CACHED, CACHED_CHARACTERS = 400_000, 8_000_000
#: Pre-tokens encoded as one string, and what parts them there; UTF-8 has no such byte.
JOINED, BETWEEN = 64, 0xFF


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where visible, else from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without a gap")
    if len({token for _, token in ranked if len(token) == 1}) < 256:
        raise ValueError("every single byte must have a rank")
    return [token for _, token in ranked]


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model; piece 0 is the unknown piece, piece r + 1 has rank r."""
    characters = byte_characters()

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    def message(field: int, body: bytes) -> bytes:
        return varint(field << 3 | 2) + varint(len(body)) + body

    def number(field: int, value: int) -> bytes:
        return varint(field << 3) + varint(value)

    def piece(text: str, score: float, kind: int) -> bytes:
        return message(1, message(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece("<unk>", 0.0, unknown)]
    pieces += [piece("".join(characters[b] for b in token), -float(rank), normal) for rank, token in enumerate(vocabulary)]
    trainer = message(2, number(3, bpe) + number(4, len(pieces)))
    normaliser = message(3, message(1, b"identity") + number(3, 0) + number(4, 0) + number(5, 0))
    return b"".join(pieces) + trainer + normaliser


class Encoder:
    """Encodes texts in one Python worker."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(model)
        self.split = regex.compile(pattern).findall
        self.mapped = {b: c for b, c in enumerate(byte_characters())} | {BETWEEN: "\x01"}  # an unknown piece, whose id is 0
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, tokens: set[str]) -> None:
        new = list(tokens.difference(self.known))
        more = sum(map(len, new))
        if len(self.known) + len(new) > CACHED or self.held + more > CACHED_CHARACTERS:
            self.known, self.held, new = {}, 0, list(tokens)
            more = sum(map(len, new))
        self.held += more
        for i in range(0, len(new), JOINED * 256):
            part = [t.encode() for t in new[i : i + JOINED * 256]]
            texts = [bytes([BETWEEN]).join(part[j : j + JOINED]).decode("latin-1").translate(self.mapped) for j in range(0, len(part), JOINED)]
            ids = np.concatenate([np.array([*x, 0], np.uint32) for x in self.processor.Encode(texts, out_type=int, num_threads=1)])
            ends = (4 * np.flatnonzero(ids == 0)).tolist()
            raw = (ids - np.uint32(1)).astype("<u4").tobytes()
            self.known.update((t, raw[a:b]) for t, a, b in zip(new[i : i + JOINED * 256], [0, *[e + 4 for e in ends[:-1]]], ends, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for i in range(0, len(texts), 256):
            split = [self.split(t) if t else [] for t in texts[i : i + 256]]
            self.learn(set().union(*split))
            out += [b"".join(map(self.known.__getitem__, tokens)) for tokens in split]
        return out


class Decoder:
    """The bytes of a vocabulary's ids, looked up for all ids of a text at once."""

    def __init__(self, vocabulary: list[bytes]):
        self.flat, self.sizes = np.frombuffer(b"".join(vocabulary), np.uint8), np.array([len(t) for t in vocabulary], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: bytes | None) -> bytes:
        every, out = np.frombuffer(ids or b"", "<u4"), []
        for i in range(0, len(every), 1 << 16):
            part = every[i : i + (1 << 16)]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.flat[np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def encode(documents: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``token_ids`` (binary, little-endian unsigned 32-bit ids) and ``n_tokens``.

    Null and empty texts have no tokens. Rows are independent: repeated rows and ties
    give repeated results, other columns pass through (columns of the two new names are
    replaced), an empty table gives an empty one.
    """
    spark = documents.sparkSession
    lean_batches(spark)
    model = spark.sparkContext.broadcast(serialise_model(read_ranks(rank_file)))

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(model.value, pattern)
        for batch in batches:
            yield pa.array(encoder.encode(batch.to_pylist()), pa.binary())
        release_memory()

    return documents.withColumn("token_ids", ids(F.col(text))).withColumn("n_tokens", F.expr("CAST(octet_length(token_ids) DIV 4 AS BIGINT)"))


def decode(encoded: DataFrame, rank_file: str, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded`` (binary): the vocabulary's bytes of each id, joined. Null ids give no bytes; a column of that name is replaced."""
    lean_batches(encoded.sparkSession)
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(vocabulary.value)
        for batch in batches:
            yield pa.array(list(map(decoder.decode, batch.to_pylist())), pa.binary())

    return encoded.withColumn("decoded", bytes_of(F.col(ids)))


def round_trip(documents: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one Python pass: add ``token_ids``, ``n_tokens`` and ``decoded``.

    The cases are those of ``encode``; a caller's columns of the three names are replaced.
    """
    lean_batches(documents.sparkSession)
    ranked, context = read_ranks(rank_file), documents.sparkSession.sparkContext
    vocabulary, model = context.broadcast(ranked), context.broadcast(serialise_model(ranked))

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = Encoder(model.value, pattern), Decoder(vocabulary.value)
        for batch in batches:
            ids = encoder.encode(batch.to_pylist())
            decoded = list(map(decoder.decode, ids))
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["ids", "decoded"])
        release_memory()

    (own,) = fresh(documents, "both")
    ids = F.col(own)["ids"]
    count = F.floor(F.octet_length(ids) / 4).cast("long")
    return documents.withColumn(own, both(F.col(text))).withColumns({"token_ids": ids, "n_tokens": count, "decoded": F.col(own)["decoded"]}).drop(own)


def digest(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null or empty text has no tokens and the hash of no bytes."""
    both = round_trip(documents.select("doc_id", "text"), rank_file, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded bytes of every document; the cases are those of ``digest``."""
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
