"""Token-id output with directly addressable codes (operator 10).

Every id is cut into 8-bit chunks.  Level 0 holds the low chunk of every id and one
continuation bit each; level 1 holds the next chunk of the ids whose bit is set, and so
on.  A rank directory (ones before every 512 bits) turns "the j-th continued id" into a
constant-time look-up, so any token is reached without decoding a block.

A table of *segments* is the file set: Spark writes it as Parquet (atomic commits,
any file system Spark can reach), one row per segment, whose ``payload`` is a
self-contained binary in the format of :func:`pack`.  Segments follow one another in
ascending ``doc_id`` order (shard, then segment); a document never spans two segments.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubjay.llm.textkernel import text_slices

MAGIC = b"DAC1"
RANK_BITS = 512
SEGMENT_TOKENS, SEGMENT_DOCS = 1 << 20, 8192
CACHE_PIECES = 500_000
JOINED_PIECES = 256  # pieces that the tokenizer gets as one text
END_ID = 0

SEGMENT_SCHEMA = ("shard int, segment int, first_token long, n_tokens long, "
                  "doc_ids array<long>, doc_tokens array<long>, payload binary")


def pack(ids: np.ndarray) -> bytes:
    """``MAGIC, levels (u1), n (u8)``, then per level ``n_l (u8), chunks (n_l bytes),
    bitmap (ceil(n_l/8) bytes), rank directory (u4 per 512 bits)``; little-endian."""
    out, levels, rest = [], 0, ids.astype(np.uint32)
    while levels == 0 or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        rank = np.concatenate(([0], np.cumsum(ones)[:-1])) if len(ones) else ones
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(),
                bits.tobytes(), rank.astype("<u4").tobytes()]
        rest = rest[more] >> 8
        levels += 1
    return b"".join([MAGIC, struct.pack("<BQ", levels, len(ids)), *out])


class Reader:
    """Random access into one packed segment; nothing is decoded on opening."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a DAC1 segment")
        count, self.n = struct.unpack_from("<BQ", payload, 4)
        at, self.levels = 13, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", payload, at)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bits = np.frombuffer(payload, np.uint8, -(-n // 8), at + 8 + n)
            rank = np.frombuffer(payload, "<u4", -(-n // RANK_BITS), at + 8 + n + len(bits))
            at += 8 + n + len(bits) + 4 * len(rank)
            self.levels.append((chunks, bits, rank))

    def _rank(self, level: int, i: int) -> int:
        """Continued ids before place ``i`` of a level."""
        _, bits, rank = self.levels[level]
        block = i // RANK_BITS
        if block >= len(rank):
            block = len(rank) - 1
        first = block * RANK_BITS // 8
        part = np.unpackbits(bits[first:-(-i // 8)], bitorder="little")[:i - block * RANK_BITS]
        return int(rank[block]) + int(part.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop``; each level is read only where the range needs it."""
        out = np.zeros(stop - start, np.uint32)
        places, lo, hi = np.arange(stop - start), start, stop
        for level, (chunks, bits, _) in enumerate(self.levels):
            if lo >= hi:
                break
            out[places] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[lo // 8:-(-hi // 8)], bitorder="little")[lo % 8:lo % 8 + hi - lo].astype(bool)
            places = places[more]
            lo = self._rank(level, lo)
            hi = lo + len(places)
        return out


# The byte-level pattern begins a pre-token at every single space and line end that has
# no other white space beside it, at the white space or character after it, and at a sign
# after a letter or digit.  So where no white space but those occurs, the pieces between
# such places encode independently.
_OTHER_SPACE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff\\0]")
_MAYBE_SPACE = np.zeros(256, bool)  # bytes that begin one of those
_MAYBE_SPACE[[*b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\0", 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def _whole(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents of a slice that have to be encoded whole."""
    space = (data == 0x20) | (data == 0x0A)
    pair = np.flatnonzero((space[:-1] & space[1:]) | ((data[:-1] == 0x3C) & (data[1:] == 0x7C)))  # 3C 7C: <|
    doc = np.searchsorted(offsets, pair, "right") - 1
    whole = np.zeros(len(offsets) - 1, bool)
    whole[doc[pair + 1 < offsets[doc + 1]]] = True
    maybe = np.unique(np.searchsorted(offsets, np.flatnonzero(_MAYBE_SPACE[data]), "right") - 1)
    for d in maybe[~whole[maybe]].tolist():
        whole[d] = _OTHER_SPACE.search(data[offsets[d]:offsets[d + 1]].tobytes().decode()) is not None
    return whole


def text_pieces(text: str) -> list[str] | None:
    """Pieces of a text at spaces and line ends only, or None if it has to be encoded whole."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "<|" in text or _OTHER_SPACE.search(text):
        return None
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


_WORD, _SIGN = np.zeros(256, bool), np.zeros(256, bool)  # ASCII only; other letters stay with what follows
_WORD[[c for c in range(128) if chr(c).isalnum()]] = True
_SIGN[0x21:0x7F] = ~_WORD[0x21:0x7F]


def _pieces(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the independent pieces of a slice begin; a whole document is one piece."""
    line = data == 0x0A
    first = line | (data == 0x20)
    first[1:] |= line[:-1] | (_WORD[data[:-1]] & _SIGN[data[1:]])
    for d in np.flatnonzero(whole).tolist():
        first[offsets[d]:offsets[d + 1]] = False
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


class _Encoder:
    """Texts to ids.  Pieces repeat a lot: a slice of texts is cut into pieces and these
    are numbered by Arrow, each distinct one is encoded once per worker (the store of
    pieces is emptied when full), and the ids of a slice are gathered in one step.  New
    pieces are encoded many at a time, joined to one text (a line end goes before a piece
    that does not begin with a space) and told apart by the byte lengths of the ids."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level token has one character a byte
            self.bytes[i] = len(token)
        self._empty()

    def _empty(self) -> None:
        alone = [self._ids(" "), self._ids("\n")]
        self.pieces: dict[str, int] = {" ": 0, "\n": 1}
        self.ids, self.counts = np.concatenate(alone), np.array([len(x) for x in alone])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _joined(self, some: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of ``size`` bytes and how many each has."""
        lined = np.array([p[0] != " " for p in some])
        text = "".join([p if p[0] == " " else "\n" + p for p in some])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at, ends = np.cumsum(self.bytes[ids]), np.cumsum(size + lined)
        cut = np.searchsorted(at, ends) + 1
        begin = np.append(0, cut[:-1])
        if not np.array_equal(at[cut - 1], ends) or (self.bytes[ids[begin[lined]]] != 1).any():
            raise ValueError("pieces do not encode independently; this is not the byte-level pattern")
        return np.delete(ids, begin[lined]), cut - begin - lined

    def _encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        whole = _whole(data, offsets)
        start = _pieces(data, offsets, whole)
        bounds = np.searchsorted(start, offsets)
        every = pa.StringArray.from_buffers(
            len(start), pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        index, distinct = every.indices.to_numpy(), every.dictionary.to_numpy(zero_copy_only=False)
        if len(self.pieces) > CACHE_PIECES:
            self._empty()
        number = np.fromiter(map(self.pieces.get, distinct, repeat(-1)), np.int64, len(distinct))
        alone = np.unique(index[bounds[:-1][whole & (np.diff(offsets) > 0)]])
        number[alone] = -2
        new = np.flatnonzero(number == -1)
        size = pc.binary_length(every.dictionary).to_numpy()
        parts = [new[lo:lo + JOINED_PIECES] for lo in range(0, len(new), JOINED_PIECES)]
        got = [self._joined(distinct[part].tolist(), size[part]) for part in parts]
        if got:
            number[new] = np.arange(len(self.counts), len(self.counts) + len(new))
            self.pieces.update(zip(distinct[new].tolist(), number[new].tolist()))
            self.ids, self.counts = (np.concatenate((x, *y)) for x, y in zip((self.ids, self.counts), zip(*got)))
        ids, counts = self.ids, self.counts
        if len(alone):  # whole documents are not kept
            got = [self._ids(text) for text in distinct[alone].tolist()]
            number[alone] = np.arange(len(counts), len(counts) + len(alone))
            ids, counts = np.concatenate((ids, *got)), np.append(counts, [len(x) for x in got])
        # gathered in the order of the pieces
        own = number[index]
        first, n = (np.cumsum(counts) - counts)[own], counts[own]
        end = np.cumsum(n)
        raw = ids[np.arange(int(n.sum())) + np.repeat(first - end + n, n)].tobytes()
        edge = (4 * np.append(0, end)[bounds]).tolist()
        return [raw[a:b] for a, b in zip(edge, edge[1:])]

    def encode(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """Ids of the texts as bytes, some texts at a time."""
        for _, _, data, offsets in text_slices(texts):
            yield self._encode_slice(data, offsets)


_encoder: tuple[int, _Encoder] | None = None


def _encoder_for(tokenizer_json: str) -> _Encoder:
    """One encoder per worker process and tokenizer."""
    global _encoder
    key = zlib.crc32(tokenizer_json.encode())
    if _encoder is None or _encoder[0] != key:
        _encoder = (key, _Encoder(tokenizer_json))
    return _encoder[1]


def _segments(tokenizer_json, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_for(tokenizer_json.value)
        end = np.array([end_id], "<u4").tobytes()
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal segment, first, ids, parts
            tokens = [len(p) // 4 for p in parts]
            row = {"shard": [shard], "segment": [segment], "first_token": [first], "n_tokens": [sum(tokens)],
                   "doc_ids": [ids], "doc_tokens": [tokens], "payload": [pack(np.frombuffer(b"".join(parts), "<u4"))]}
            segment, first, ids, parts = segment + 1, first + sum(tokens), [], []
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("shard", pa.int32()), ("segment", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
                ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("payload", pa.binary())]))

        size = 0
        for batch in batches:
            doc_ids = iter(batch.column(0).to_pylist())
            for some in encoder.encode(batch.column(1)):
                for raw in some:
                    ids.append(next(doc_ids))
                    parts.append(raw + end)
                    size += len(raw) // 4 + 1
                    if size >= SEGMENT_TOKENS or len(ids) >= SEGMENT_DOCS:
                        yield close()
                        size = 0
        if ids:
            yield close()
    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Encode ``doc_id``, ``text`` of ``docs`` in ascending ``doc_id`` order (null ids
    first, equal ids by text) and write the segments to ``path``.  Null and empty texts
    become the end id alone; other columns are not read.  Texts are dealt to ordered
    ranges before they are encoded, so each is encoded once; a range streams through its
    task a segment at a time."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = spark.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranges.mapInArrow(_segments(tokenizer_json, end_id), SEGMENT_SCHEMA).write.parquet(path)


def _located(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``base``, the tokens of all earlier shards.  There is one shard per
    write task, so the table of shard sizes is as small as the list of files."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return segments.join(F.broadcast(bases), "shard")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            reader, at = Reader(row["payload"]), 0
            starts, ids, crcs = [], [], []
            for n in row["doc_tokens"]:
                own = reader.range(at, at + n).astype("<u4")
                starts.append(row["base"] + row["first_token"] + at)
                crcs.append(zlib.crc32(own.tobytes()))
                ids.append(own)
                at += n
            for lo in range(0, len(ids), 256):
                hi = lo + 256
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"][lo:hi], pa.int64()), pa.array(starts[lo:hi], pa.int64()),
                    pa.array(row["doc_tokens"][lo:hi], pa.int64()), pa.array(crcs[lo:hi], pa.int64()),
                    pa.array(ids[lo:hi], pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            reader, at, starts, crcs = Reader(row["payload"]), 0, [], []
            raw = memoryview(reader.range(0, reader.n).astype("<u4").tobytes())
            for n in row["doc_tokens"]:
                starts.append(row["base"] + row["first_token"] + at)
                crcs.append(zlib.crc32(raw[4 * at:4 * (at + n)]))
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                 pa.array(row["doc_tokens"], pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


_NEEDED = ["base", "first_token", "doc_ids", "doc_tokens", "payload"]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document in the files."""
    return _located(spark, path).select(_NEEDED).mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_token_files`, without the ids themselves."""
    return _located(spark, path).select(_NEEDED).mapInArrow(
        _read_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Tokens at global ``position`` values: a range join of positions to segments by
    (coarse block of positions), then one constant-time look-up each."""
    located = _located(spark, path).withColumn("lo", F.col("base") + F.col("first_token"))
    block = 1 << 20
    spans = located.select("lo", "n_tokens", "payload", F.explode(F.sequence(
        F.floor(F.col("lo") / block), F.floor((F.col("lo") + F.col("n_tokens") - 1) / block))).alias("block"))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("block", F.floor(F.col("position") / block))
    hit = asked.join(spans, "block").where("position >= lo and position < lo + n_tokens").select(
        "position", (F.col("position") - F.col("lo")).alias("place"), "payload")

    def look(batches):
        for batch in batches:
            tokens = [Reader(p)[i] for p, i in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64())], names=["position", "token"])
    return hit.mapInArrow(look, "position long, token long")
