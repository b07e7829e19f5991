"""Alignment of two tokenizations by the byte offsets where their tokens end (operator 11).

Each text is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B).  The
cumulative ends of a text's tokens are the keys of two end-to-index dictionaries; the keys
that both hold are the common cuts.  In ascending order they slice both id lists into
groups, and in each slice the pairs of tokens whose byte ranges end together are links:
the last of A with the last of B, since ends inside a slice are not common.

Ends are small integers, so for a batch of texts the two dictionaries are one table
indexed by the end itself: A's ends write their index, B's ends look theirs up.  That is
the intersection of the two key sets, in order, for all texts of the batch at once.

How often an id pair is linked is counted over all documents.  The counts come back to the
links by a join: broadcast up to ``BROADCAST_PAIRS`` distinct pairs, beyond that by a
shuffle in which pairs that hold a thousandth of the links are still broadcast (at most
a thousand of them).  A document's sums are combined before they are shuffled.

Edge cases: a text that is null or empty, or that does not come back byte for byte from
either tokenizer, has no tokens.  Strings of special tokens are plain text.  Rows that
repeat are counted each; a null doc_id is a row like any other; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import written
from scrubjay.llm.token_files import _Encoder, text_pieces
from scrubjay.plans.skew import join_classes

BROADCAST_PAIRS = 1_000_000
CACHE_PIECES = 400_000
SLICE_BYTES = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable Latin-1 stands for itself,
    the other bytes for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return out | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Decimal:
    """Decimal digits of ids below ``n``, a row of bytes each, with a place for a mark."""

    def __init__(self, n: int):
        width = len(str(n - 1))
        ids = np.arange(n)
        self.size = np.maximum(1, np.floor(np.log10(np.maximum(ids, 1))).astype(np.int64) + 1)
        places = self.size[:, None] - 1 - np.arange(width)
        digits = np.where(places >= 0, ids[:, None] // 10 ** np.maximum(places, 0) % 10 + 48, 0)
        self.rows = np.zeros((n, width + 1), np.uint8)
        self.rows[:, :width] = digits


class Tokenizers:
    """Both encoders of a worker, with the bytes of every id.

    Texts without double white space are cut at single spaces and line ends, where neither
    tokenizer joins (A begins a pre-token there; no piece of B has a space inside, and a
    line end is a byte of its own).  Each distinct piece is encoded once, until the store is
    full and emptied; other texts are encoded whole."""

    def __init__(self, tokenizer_json: str, piece_model: bytes):
        import sentencepiece

        self.a = _Encoder(tokenizer_json)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        alphabet = byte_alphabet()
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * self.n_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes_b = [b""] * self.n_b
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            self.bytes_b[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
        # pieces of B may begin with spaces, or be spaces; one with a space further in would join words
        self.apart = not any(" " in b.decode("utf-8", "replace").lstrip(" ") for b in self.bytes_b)
        self.line_end = self.b.encode("\n")[1:]
        self.apart &= len(self.line_end) == 1
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.decimal_a, self.decimal_b = _Decimal(self.n_a), _Decimal(self.n_b)
        self.pieces: dict[str, bytes | None] = {}

    def _same(self, text: str, ids, table: list[bytes]) -> bool:
        return b"".join([table[i] for i in ids]) == text.encode()

    def _learn(self, new: list[str]) -> None:
        """Ids of B of pieces: encoded many at a time with line ends between them, which
        come back as one id each."""
        (mark,) = self.line_end
        plain = [p for p in new if p != "\n"]
        if len(plain) < len(new):
            self.pieces["\n"] = np.array([mark], "<u4").tobytes()
        for lo in range(0, len(plain), 4000):
            some = plain[lo:lo + 4000]
            # the line end in front takes the space that B adds
            ids = np.array(self.b.encode("\n" + "\n".join(some)), "<u4")
            cuts = np.append(np.flatnonzero(ids == mark), len(ids))
            if len(cuts) != len(some) + 1:
                raise ValueError("a piece holds a line end")
            raw, at = ids.tobytes(), cuts.tolist()
            for p, begin, end in zip(some, at, at[1:]):
                part = raw[4 * begin + 4:4 * end]
                self.pieces[p] = part if self._same(p, np.frombuffer(part, "<u4").tolist(), self.bytes_b) else None

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """(ids of A, ids of B) of each text as little-endian 32-bit integers, for A with a
        space in front; None for a text that does not come back from both."""
        spaced = [" " + t for t in texts]
        ids_a = [a for some in self.a.encode(pa.array(spaced, pa.string())) for a in some]
        cut = [text_pieces(t) if self.apart else None for t in spaced]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        pieces = self.pieces
        pieces.setdefault("", b"")
        self._learn([p for p in set().union(*filter(None, cut)) if p not in pieces])
        out: list[tuple[bytes, bytes] | None] = []
        for text, spaced_text, a, c in zip(texts, spaced, ids_a, cut):
            if not text:
                out.append(None)
                continue
            if c is None:
                b = np.array(self.b.encode(text), "<u4").tobytes()
                good = self._same(spaced_text, np.frombuffer(b, "<u4").tolist(), self.bytes_b)
            else:
                parts = [pieces[p] for p in c]
                good = None not in parts
                b = b"".join(parts) if good else b""
            good = good and int(self.size_a[np.frombuffer(a, "<u4")].sum()) == len(spaced_text.encode())
            if good and c is None:
                good = self._same(spaced_text, np.frombuffer(a, "<u4").tolist(), self.bytes_a)
            out.append((a, b) if good else None)
        return out


def align(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into the two id lists where common ends are: the last token of A and of B of
    every group, in order.  Both lists cover the same bytes."""
    ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    index_of = np.full(int(ends_a[-1]) + 1 if len(ends_a) else 1, -1, np.int64)  # A's ends -> index
    index_of[ends_a] = np.arange(len(ids_a))
    last_a = index_of[ends_b]
    last_b = np.flatnonzero(last_a >= 0)
    return last_a[last_b], last_b


def groups_text(ids_a, ids_b, last_a, last_b, decimal_a: _Decimal, decimal_b: _Decimal) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` as bytes, and the length of each group's part of it."""
    sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    before_a, before_b = np.concatenate(([0], np.cumsum(sizes_b)[:-1])), np.cumsum(sizes_a)
    place_a = np.arange(len(ids_a)) + np.repeat(before_a, sizes_a)  # A's tokens of a group come first
    place_b = np.arange(len(ids_b)) + np.repeat(before_b, sizes_b)
    width = max(decimal_a.rows.shape[1], decimal_b.rows.shape[1])
    rows = np.zeros((len(ids_a) + len(ids_b), width), np.uint8)
    for ids, place, last, decimal, mark in ((ids_a, place_a, last_a, decimal_a, b"|"), (ids_b, place_b, last_b, decimal_b, b";")):
        own = decimal.rows[ids]
        marks = np.full(len(ids), ord(","), np.uint8)
        marks[last] = ord(mark)
        own[np.arange(len(ids)), decimal.size[ids]] = marks
        rows[place, :own.shape[1]] = own
    used = rows != 0
    per_group = np.add.reduceat(used.sum(axis=1), np.concatenate(([0], np.cumsum(sizes_a + sizes_b)[:-1]))) if len(last_a) else np.zeros(0, np.int64)
    return rows[used], per_group


_tokenizers: tuple[int, Tokenizers] | None = None


def _tokenizers_for(tokenizer_json: str, piece_model: bytes) -> Tokenizers:
    """One pair of tokenizers per worker process and files."""
    global _tokenizers
    key = zlib.crc32(piece_model, zlib.crc32(tokenizer_json.encode()))
    if _tokenizers is None or _tokenizers[0] != key:
        _tokenizers = (key, Tokenizers(tokenizer_json, piece_model))
    return _tokenizers[1]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > SLICE_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def _aligned(files, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers_for(*files.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                yield _aligned_slice(tokenizers, batch.column(0).slice(lo, hi - lo), [t or "" for t in texts[lo:hi]], keep_groups)
    return run


def _aligned_slice(t: Tokenizers, ids: pa.Array, texts: list[str], keep_groups: bool) -> pa.RecordBatch:
    encoded = t.encode(texts)
    pairs = [x or (b"", b"") for x in encoded]
    a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in zip(*pairs))
    n_a, n_b = (np.array([len(x[k]) // 4 for x in pairs], np.int64) for k in (0, 1))
    # texts follow one another, and both lists of a text end together: cuts between texts are common
    last_a, last_b = align(a, b, t.size_a, t.size_b)
    raw, per_group = groups_text(a, b, last_a, last_b, t.decimal_a, t.decimal_b)
    first = np.searchsorted(last_a, np.concatenate(([0], np.cumsum(n_a))), "left")
    n_groups = np.diff(first)
    ends = np.concatenate(([0], np.cumsum(per_group)))[first]
    text, at = raw.tobytes(), ends.tolist()
    parts = [text[i:j - 1] if j > i else b"" for i, j in zip(at, at[1:])]
    # a pair of ids as one number; both vocabularies together stay far below 2**63
    links = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(a[last_a] * t.n_b + b[last_b], pa.int64()))
    columns = [ids.cast(pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(n_groups),
               pa.array([hashlib.sha256(p).hexdigest() if p else "" for p in parts]), links]
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
    if keep_groups:
        columns, names = columns + [pa.array([p.decode() for p in parts])], names + ["groups"]
    return pa.RecordBatch.from_arrays(columns, names)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"


def align_texts(docs: DataFrame, tokenizer_json_path: str, piece_model_path: str, groups: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): numbers of tokens and groups, the digest of the
    groups, and ``links``, a number per link: id of A * size of B's vocabulary + id of B.
    With ``groups`` also the groups as text, ``a1,a2|b1;a3|b2,b3``.  The two vocabulary files
    (a few MB) are broadcast."""
    with open(tokenizer_json_path, encoding="utf-8") as f, open(piece_model_path, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(_aligned(files, groups), ALIGNED + (", groups string" if groups else ""))


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, count (links that hold it, over all documents), best (whether no other pair of
    its B id has more)."""
    counts = written(aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "align-counts")
    b = F.col("pair") % n_b
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_strengths(docs: DataFrame, tokenizer_json_path: str, piece_model_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """:func:`align_texts` without the links, but with their number, how many of them hold
    the commonest pair of their B id (ties included), and the sum of their pairs' counts.
    The encoded table is written once, so that no text is encoded again."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=piece_model_path).get_piece_size()
    aligned = written(align_texts(docs, tokenizer_json_path, piece_model_path).withColumn("row", F.monotonically_increasing_id()), "align-rows")
    counts = written(pair_counts(aligned, n_b), "align-pairs")
    seen = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    links = aligned.select("row", F.explode("links").alias("pair"))
    if seen[0] <= broadcast_pairs:
        found = links.join(F.broadcast(counts), "pair")
    else:
        found = join_classes(links, counts, "pair", "count", seen[1])
    sums = found.groupBy("row").agg(F.count(F.lit(1)).alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"),
                                    F.sum("count").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return aligned.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *zero, "groups_sha256")


def groups_of(text: str) -> list[tuple[list[int], list[int]]]:
    """The groups of a ``groups`` text as lists of ids."""
    return [tuple([int(i) for i in side.split(",")] for side in g.split("|")) for g in re.split(";", text) if g]
