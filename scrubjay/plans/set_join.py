"""Lossless candidates by word Jaccard: posting lists of rare words, counted block by block.

Words stand in one order, from rare to frequent (by the counts of their hash buckets, then by
hash; any order that all texts share loses nothing).  Two sets of na <= nb words with
Jaccard of at least ``tau`` share ``need`` words or more, and so at least ``k`` of them among
the first ``na - need + k`` and ``nb - need + k``.  The smaller set of a pair is indexed by
those first words, the larger one asks with its own, and a pair is a candidate only when it
is hit ``k`` times (Wang et al., AdaptJoin, 2012).  A pair that shares a rare word by chance
is counted where the index lies and never becomes a row, and neither does one that all words
of both sets, compared there, show to be below ``tau``.

Index rows fall into blocks of similar set sizes and bounded posting entries; a set asks only
the blocks whose sizes it can reach.  Askers of a block are dealt to several parts, each of
which reads its index once and then streams its askers.  Words are 32 bits of their hash
there: a collision can only add a candidate, which the callers verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import word_set

EPS = 1e-9
#: Hash buckets whose words are counted together, and pieces that the counts travel in.
BUCKETS, PIECES = 1 << 21, 32
#: Share of a set's words that a candidate must share beyond the first.
EXTRA = 0.05
#: Posting entries of a block, and askers of one of its parts (fewer up to ``SPREAD`` parts).
BLOCK_ENTRIES, PART_ROWS, SPREAD, SPREAD_ROWS = 4_000_000, 50_000, 4, 10_000


def hashed_words(norm) -> F.Column:
    """64-bit hashes of the distinct words of a normalized text."""
    return F.transform(word_set(norm), lambda w: F.xxhash64(w))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list<long> column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(column.offsets.to_numpy())


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of ``values`` as binaries."""
    offsets = np.concatenate(([0], np.cumsum(lengths))) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _extra(n: np.ndarray, tau: float) -> np.ndarray:
    """Hits that the smaller set of a pair, of ``n`` words, must have (never more than the words
    it must share; grows with ``n``)."""
    return np.minimum(1 + np.floor(EXTRA * n), np.ceil(2 * tau / (1 + tau) * n - EPS)).astype(np.int64)


def index_words(n: np.ndarray, tau: float) -> np.ndarray:
    """First words of a set of ``n`` that are indexed: its partners are as large or larger."""
    return np.minimum(n, n - np.ceil(2 * tau / (1 + tau) * n - EPS).astype(np.int64) + _extra(n, tau))


def asked_words(n: np.ndarray, tau: float) -> np.ndarray:
    """First words that a set of ``n`` asks with: its partners are as large or smaller."""
    return np.minimum(n, n - np.ceil(tau * n - EPS).astype(np.int64) + _extra(n, tau))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words per hash bucket in ``PIECES`` rows, and sets per size (piece -1)."""
    counts, sizes = np.zeros(BUCKETS, np.uint32), np.zeros(0, np.uint32)
    for batch in batches:
        values, lengths = _lists(batch.column(0))
        at, n = np.unique(values & np.uint64(BUCKETS - 1), return_counts=True)
        counts[at.astype(np.int64)] += n.astype(np.uint32)
        own = np.bincount(lengths).astype(np.uint32)
        sizes, own = sorted((sizes, own), key=len, reverse=True)
        sizes[:len(own)] += own
    pieces = np.split(counts, PIECES)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *range(PIECES)], pa.int32()), pa.array([sizes.tobytes(), *(p.tobytes() for p in pieces)], pa.binary())],
                                     names=["piece", "counts"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sorted((held.get(piece, np.zeros(0, np.int64)), np.frombuffer(raw, np.uint32).astype(np.int64)), key=len, reverse=True)
            a[:len(b)] += b
            held[piece] = a
    if held:
        # counts of words in eighths of a doubling
        rows = [n.tobytes() if k < 0 else np.minimum(255, np.ceil(8 * np.log2(np.maximum(n, 1)))).astype(np.uint8).tobytes() for k, n in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(rows, pa.binary())], names=["piece", "counts"])


def _blocks(sizes: np.ndarray, tau: float) -> list[tuple[int, int, int, int, int, int]]:
    """(id, lo, hi, subs, sub, parts): sets of lo to hi words, one in ``subs`` of them by hash."""
    n = np.arange(len(sizes))
    entries = sizes * index_words(n, tau)
    first, out, room = 1, [], 0
    spans = []
    for size in np.flatnonzero(sizes[1:]) + 1:
        if room and room + entries[size] > BLOCK_ENTRIES:
            spans.append((first, int(size) - 1, room))
            first, room = int(size), 0
        room += int(entries[size])
    spans.append((first, max(len(sizes) - 1, first), room))
    for lo, hi, room in spans:
        subs = max(1, -(-room // BLOCK_ENTRIES))
        askers = int(sizes[lo:int(hi / tau + EPS) + 1].sum())
        parts = max(1, -(-askers // PART_ROWS), min(SPREAD, askers // SPREAD_ROWS))
        out += [(len(out) + sub, lo, hi, subs, sub, parts) for sub in range(subs)]
    return out


def _packed(codes):
    """key, v, nc, nw and the words of each set, in the common order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.frombuffer(codes.value, np.uint8).astype(np.uint64)
        for batch in batches:
            values, lengths = _lists(batch.column(3))
            words = (code[(values & np.uint64(BUCKETS - 1)).astype(np.int64)] << np.uint64(56)) | (values >> np.uint64(8))
            row = np.repeat(np.arange(len(lengths)), lengths)
            words = words[np.lexsort((words, row))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths, pa.int32()), _binary(words.astype(np.uint32), lengths)],
                                             names=["key", "v", "nc", "nw", "words"])
    return run


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of them in each row) of a column of binaries, without a copy per row."""
    chunks = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    values, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for c in chunks:
        _, offsets, data = c.buffers()
        ends = np.frombuffer(offsets, np.int32)[c.offset:c.offset + len(c) + 1]
        values.append(np.frombuffer(data if data is not None else b"", np.uint8)[ends[0]:ends[-1]].view(np.uint32))
        lengths.append(np.diff(ends).astype(np.int64) // 4)
    return np.concatenate(values), np.concatenate(lengths)


def _first(words: np.ndarray, lengths: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The first ``kept`` words of each row."""
    place = np.arange(len(words), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    return words[place < np.repeat(kept.astype(np.int32), lengths)]


class _Index:
    """Posting lists of the first words of a block's sets, which are sorted by size."""

    def __init__(self, parts: list[pa.RecordBatch], tau: float):
        rows = pa.Table.from_batches(parts)
        rows = rows.take(pa.array(np.argsort(rows["nw"].to_numpy(), kind="stable"))).combine_chunks()
        self.rows = rows.select(["key", "v"])
        self.n, self.nc, self.tie = (rows[c].to_numpy() for c in ("nw", "nc", "tie"))
        self.need = _extra(self.n, tau)
        self.all, lengths = _words(rows["words"])
        del rows
        self.first, kept = np.cumsum(lengths) - lengths, index_words(lengths, tau)
        words = _first(self.all, lengths, kept)
        order = np.argsort(words, kind="stable")
        self.at = np.repeat(np.arange(len(lengths), dtype=np.int32), kept)[order]
        words = words[order]
        self.begin = np.flatnonzero(np.concatenate((np.ones(min(len(words), 1), bool), words[1:] != words[:-1])))
        self.words, self.end = words[self.begin], np.append(self.begin[1:], len(words))


def _meet(tau: float, bound):
    """Candidate pairs of the rows of (block, part): index rows first, then askers."""
    def hits(index: _Index, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        whole, sizes = _words(batch.column("words"))
        begin, lengths = np.cumsum(sizes) - sizes, asked_words(sizes, tau)
        words = _first(whole, sizes, lengths)
        at = np.minimum(np.searchsorted(index.words, words), len(index.words) - 1)
        at = np.where(index.words[at] == words, at, -1)
        n, nc, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("nw", "nc", "tie"))
        lo = np.searchsorted(index.n, np.ceil(tau * n - EPS))
        hi = np.searchsorted(index.n, n, side="right")
        mine, theirs, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for j, size in enumerate(lengths.tolist()):
            own = at[first:first + size]
            first, own = first + size, own[own >= 0]
            if not len(own) or lo[j] >= hi[j]:
                continue
            lists = [index.at[a:b] for a, b in zip(index.begin[own].tolist(), index.end[own].tolist())]
            hit = np.concatenate(lists)
            if 16 * len(hit) < hi[j]:  # few hits: no count for every row
                found, count = np.unique(hit[(hit >= lo[j]) & (hit < hi[j])], return_counts=True)
                found = found[count >= index.need[found]].astype(np.int64)
            else:
                count = np.bincount(hit, minlength=hi[j])[lo[j]:hi[j]]
                found = np.flatnonzero(count >= index.need[lo[j]:hi[j]]) + lo[j]
            if not len(found):
                continue
            # of two sets of one size, the one with the smaller tie is the indexed one
            found = found[(index.n[found] < n[j]) | (index.tie[found] < tie[j])]
            if bound is not None and len(found):
                found = found[bound(index.nc[found], nc[j], index.n[found], n[j])]
            if len(found):
                # all words of these few sets
                own = np.sort(whole[begin[j]:begin[j] + n[j]])
                theirs_all = np.concatenate([index.all[index.first[k]:index.first[k] + index.n[k]] for k in found.tolist()])
                is_own = own[np.minimum(np.searchsorted(own, theirs_all), n[j] - 1)] == theirs_all
                same = np.minimum(np.add.reduceat(is_own, np.cumsum(index.n[found]) - index.n[found], dtype=np.int64), index.n[found])
                jac = same / (n[j] + index.n[found] - same)
                good = jac >= tau - EPS
                if bound is not None:
                    good &= bound(index.nc[found], nc[j], index.n[found], n[j], jac)
                found = found[good]
            if len(found):
                mine.append(found)
                theirs.append(np.full(len(found), j))
        return np.concatenate(mine), np.concatenate(theirs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, index = None, [], None
        for batch in batches:
            block, part, kind = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "part", "kind"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if lo == hi:
                    continue
                if place != (block[lo], part[lo]):
                    place, parts, index = (block[lo], part[lo]), [], None
                if kind[lo] == 0:
                    parts.append(batch.slice(lo, hi - lo))
                elif parts or index is not None:
                    if index is None:
                        index, parts = _Index(parts, tau), []
                    some = batch.slice(lo, hi - lo)
                    mine, theirs = hits(index, some)
                    for a in range(0, len(mine), 50_000):
                        m, t = pa.array(mine[a:a + 50_000]), pa.array(theirs[a:a + 50_000])
                        yield pa.RecordBatch.from_arrays(
                            [*(index.rows[c].take(m).combine_chunks() for c in ("key", "v")), *(some.column(c).take(t) for c in ("key", "v"))],
                            names=["ka", "a", "kb", "b"])
    return run


def set_candidates(texts: DataFrame, tau: float, bound=None) -> DataFrame:
    """(u, v, uk, vk), u before v, of all pairs of distinct ``texts`` (key, v, norm, nc; rows
    that repeat a key count once, by their smallest v) with word Jaccard of at least ``tau``
    (and some more pairs).  ``bound(nca, ncb, nwa, nwb, jaccard)`` on arrays may rule pairs out by
    their lengths and numbers of words, the first set being the smaller one, and then by their
    Jaccard (None at first), which a collision can only make larger."""
    spark = texts.sparkSession
    some = texts.select(F.col("key"), F.col("v"), F.col("nc").cast("int").alias("nc"), hashed_words(F.col("norm")).alias("h"))
    tallied = some.select("h").mapInArrow(_tally, "piece int, counts binary").repartition(PIECES, "piece") \
        .mapInArrow(_sums, "piece int, counts binary").collect()  # a byte a bucket, a long a size
    rows = {r.piece: bytes(r.counts) for r in tallied}
    sizes = np.frombuffer(rows.get(-1, b""), np.int64)
    kind = T.StructType([T.StructField(n, texts.schema[c].dataType) for n, c in (("ka", "key"), ("a", "v"), ("kb", "key"), ("b", "v"))])
    blocks = _blocks(sizes, tau)
    codes = spark.sparkContext.broadcast(b"".join(rows.get(i, bytes(BUCKETS // PIECES)) for i in range(PIECES)))
    schema = T.StructType([texts.schema["key"], texts.schema["v"]]).add("nc", "integer").add("nw", "integer").add("words", "binary")
    sets = some.mapInArrow(_packed(codes), schema).groupBy("key").agg(
        F.min("v").alias("v"), *[F.first(c).alias(c) for c in ("nc", "nw", "words")]).where("nw > 0")
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("id", "lo", "hi", "subs", "sub", "parts"), b)]) for b in blocks])
    tied = sets.withColumn("tie", F.xxhash64("key"))
    own = F.filter(table, lambda b: (b["lo"] <= F.col("nw")) & (F.col("nw") <= b["hi"]) & (F.pmod(F.col("tie"), b["subs"]) == b["sub"]))
    reached = F.filter(table, lambda b: (b["lo"] <= F.col("nw")) & (b["hi"] >= F.ceil(F.lit(tau) * F.col("nw") - F.lit(EPS))))
    place = lambda block, part, kind: F.struct(block["id"].alias("block"), part.cast("int").alias("part"), F.lit(kind).alias("kind"))
    indexed = F.flatten(F.transform(own, lambda b: F.transform(F.sequence(F.lit(0), b["parts"] - 1), lambda p: place(b, p, 0))))
    asking = F.transform(reached, lambda b: place(b, F.pmod(F.xxhash64("tie"), b["parts"]), 1))
    dealt = tied.select("*", F.explode(F.concat(indexed, asking)).alias("at")).select(
        "at.*", "key", "v", "nc", "nw", "tie", "words")
    total = max(sum(b[-1] for b in blocks), 1)
    met = dealt.repartition(total, "block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(_meet(tau, bound), kind)
    pair = lambda f: f(F.struct(F.col("a").alias("v"), F.col("ka").alias("k")), F.struct(F.col("b").alias("v"), F.col("kb").alias("k")))
    ends = met.select(pair(F.least).alias("x"), pair(F.greatest).alias("y"))
    return ends.where("x.v < y.v").select(F.col("x.v").alias("u"), F.col("y.v").alias("v"), F.col("x.k").alias("uk"), F.col("y.k").alias("vk"))
