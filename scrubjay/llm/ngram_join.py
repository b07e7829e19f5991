"""Exact n-gram Jaccard join by universe partition (operator 2).

A document's set holds the hashes of its distinct 5-word shingles.  Two sets link when
``den * intersection >= num * union`` (80/100 by default).

*Candidates.*  Sets fall into size bands; each band cuts the universe of hashes into
segments.  A linked pair whose smaller set lies in a band differs in at most ``H``
shingles there, so of ``m`` segments at least ``m - H`` hold identical subsets
(pigeonhole).  A set indexes the subset of every non-empty segment under its own band
and, if it can link into the band below, under that band too.

*Cost-based allocation.*  ``m`` is the smallest count that leaves more usable subsets (of
two hashes or more) than a set can differ in, by a margin; index rows are the cost.  The
surplus is used twice.  A linked pair agrees on at least that many subsets, so a set that
meets others on fewer is dropped (count filter).  And subsets on long posting lists are
skipped while some surplus is left.  Sets without it are the only ones for which long
lists matter: two of them are compared with one centre a list and contracted, and a list
is then used like a short one if few of them lie outside its largest component, as in a
family of near copies of any size.  Only sets that still skip too many lists get
the dearer one-deletion neighbourhoods: about ``H/2`` larger segments, each indexed by
its subset and by every subset with one hash removed, so that segments which differ once
still meet.  These lists are used at any length.

*Verification.*  Documents of a posting list are compared with one centre at first;
linked ones are contracted to components, and only pairs across components that are still untested, and that sizes and parity bitmaps of the sets
allow, are then compared.  Every comparison is exact, on whole texts.

Edge cases: null, empty or blank texts have no shingles and link with nothing; a text of
fewer than ``k`` words has its whole sequence as one shingle; exact copies form one class
and are compared once; rows with a null ``doc_id`` get a null component; rows that repeat
a ``doc_id`` are one document whose texts may each link.  Shingles are compared by 54-bit
hashes (chance of any error within one pair of 1,000-word texts about 1e-10).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm import graph
from scrubjay.llm.common import written
from scrubjay.llm.textkernel import HASH_BITS, U64, mix, shingle_sets, text_slices, words

BUCKET_ROWS = 1_000_000     # index rows per reduce bucket (sizing only)
FLUSH_ROWS = 1_000_000     # index rows a map task holds before it emits blocks
LONG_LIST = 32             # posting lists above this are skipped at the first level
OUTSIDE = 1024              # members outside its largest component up to which a long list costs less than deletions
STAR_TURNS = 1             # rounds against one centre a list before the pairs that remain
CHUNK = 2048               # members of a list that one group holds in the last round
SKETCH_BYTES = 128         # parity bitmap: its Hamming distance bounds the difference from below


class Scheme:
    """Bands, difference bounds and segment counts for one threshold ``num/den``."""

    def __init__(self, num: int = 80, den: int = 100, largest: int = 1 << 31):
        g = math.gcd(num, den)
        self.num, self.den = num // g, den // g
        lo, bands = 1, []
        while lo < largest:
            hi = max(lo + 1, -(-lo * 3 // 2), -(-lo * self.den // self.num))
            bands.append((lo, hi))
            lo = hi
        self.lo = np.array([b[0] for b in bands], np.int64)
        self.hi = np.array([b[1] for b in bands], np.int64)
        self.least = np.where(self.lo >= 24, 2, 1)  # hashes a subset must hold to be indexed
        self.exact = np.array([self._segments(b) for b in range(len(bands))], np.int64)
        worst = self.differ(self.hi - 1, np.zeros(len(bands), np.int64), 0)
        self.pairs = worst // 2 + 1
        self.roomy = self.pairs + self.pairs // 4 + 2

    def differ(self, sizes: np.ndarray, band: np.ndarray, slot: int) -> np.ndarray:
        """Most hashes in which a set of each size differs from one it links with under a
        slot's scheme: |r xor s| <= (den-num)/(den+num) (|r|+|s|), |s| <= |r| den/num."""
        other = sizes * self.den // self.num
        if slot:  # the partner lies in the scheme's band, which is below the set's own
            other = np.minimum(other, self.hi[band] - 1)
        return (sizes + other) * (self.den - self.num) // (self.den + self.num)

    def _segments(self, band: int) -> int:
        """Fewest segments that leave every size of the band 15 % more usable subsets in
        expectation than it can differ in (index rows are the cost, the surplus pays for
        skipped lists and drives the count filter), or the best that can be had."""
        sizes = np.array([self.lo[band], self.hi[band] - 1], np.int64)
        worst = self.differ(sizes, np.zeros(2, np.int64), 0)
        if worst[1] == 0:
            return 1
        best, surplus = 1, -math.inf
        m = int(worst[1]) + 1
        while m < 4 * sizes[1]:
            rate = sizes / m
            usable = m * (1 - np.exp(-rate) * (1 + (rate if self.least[band] == 2 else 0)))
            spare = float((usable / (1.15 * worst + 2)).min())
            if spare > surplus:
                best, surplus = m, spare
            if spare >= 1:
                return m
            m += max(1, m // 64)
        return best

    def bands_of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each size's own band and whether a set of it can link into the band below."""
        own = np.searchsorted(self.hi, sizes, "right")
        below = (own > 0) & (sizes * self.num <= (self.hi[np.maximum(own - 1, 0)] - 1) * self.den) & (sizes > 0)
        return own, below


class Sets:
    """Shingle sets of a slice of documents with what their joins need."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int):
        self.doc, self.hash = shingle_sets(words(data, offsets, lower=True), k)
        docs = len(offsets) - 1
        self.size = np.bincount(self.doc, minlength=docs)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        mixed = mix(self.hash + U64(1))
        self.mixed = mixed
        self.key = _sums(mixed, self.first) & ~U64(1)
        self.check = _sums(mix(mixed ^ U64(0x5851F42D4C957F2D)), self.first)

    def segments(self, docs: np.ndarray, count: np.ndarray, salt: np.ndarray):
        """(document, signature, first, end) of each non-empty segment of the documents
        where ``docs`` is true, cut into ``count`` segments each."""
        use = docs[self.doc]
        doc, h, mixed = self.doc[use], self.hash[use], self.mixed[use]
        if not len(doc):
            z = np.zeros(0, np.int64)
            return z, z.astype(U64), z, z, mixed
        seg = ((h >> U64(HASH_BITS - 32)) * count.astype(U64)[doc]) >> U64(32)
        start = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1]))))
        end = np.append(start[1:], len(doc))
        label = mix(salt.astype(U64)[doc[start]] * U64(1 << 32) + seg[start])
        return doc[start], label, start, end, mixed

    def sketches(self) -> np.ndarray:
        """Parity bitmaps: bit (hash mod bits) flips for each shingle."""
        bits = SKETCH_BYTES * 8
        flat = np.bincount(self.doc * bits + (self.mixed % U64(bits)).astype(np.int64),
                           minlength=len(self.size) * bits)
        return np.packbits((flat & 1).astype(bool).reshape(-1, bits), axis=1)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    return total[first[1:]] - total[first[:-1]]


def _slot(sets: Sets, scheme: Scheme, slot: int):
    """Documents, bands of one slot: 0 is the own band, 1 the band below."""
    own, below = scheme.bands_of(sets.size)
    use = (sets.size > 0) if slot == 0 else below
    return use, np.maximum(own - slot, 0)


def _exact(sets: Sets, scheme: Scheme, slot: int):
    use, band = _slot(sets, scheme, slot)
    doc, label, start, end, mixed = sets.segments(use, scheme.exact[band], band)
    big = end - start >= scheme.least[band][doc] if len(doc) else np.zeros(0, bool)
    doc, label, start, end = doc[big], label[big], start[big], end[big]
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mixed, dtype=U64)))
    return doc, mix((total[end] - total[start]) ^ label), band


def _headers(scheme: Scheme, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                s = Sets(data, offsets, k)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(s.size, pa.int64()),
                        pa.array(s.key.view(np.int64)), pa.array(s.check.view(np.int64))]
                for slot in (0, 1):
                    doc, _, band = _exact(s, scheme, slot)
                    use, _ = _slot(s, scheme, slot)
                    spare = np.bincount(doc, minlength=hi - lo) - scheme.differ(s.size, band, slot)
                    cols.append(pa.array(spare, pa.int64(), mask=~use))
                cols.append(pa.array([x.tobytes() for x in s.sketches()], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "key", "check", "spare0", "spare1", "sketch"])
    return run


def _blocks(scheme: Scheme, k: int, bits: int):
    """Index rows as blocks: per reduce bucket the entries (class key, slot in its lowest
    bit), their counts, and 40 further bits of each signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                s = Sets(data, offsets, k)
                _, once = np.unique(s.key, return_index=True)
                fresh = np.zeros(len(s.size), bool)
                fresh[once] = True
                for slot in (0, 1):
                    doc, sig, _ = _exact(s, scheme, slot)
                    own = fresh[doc]
                    held.append((sig[own], s.key[doc[own]] | U64(slot)))
                    rows += int(own.sum())
                if rows >= FLUSH_ROWS:
                    yield _pack(held, bits)
                    held, rows = [], 0
        if rows:
            yield _pack(held, bits)
    return run


def _pack(held, bits: int) -> pa.RecordBatch:
    sig, entry = (np.concatenate(x) for x in zip(*held))
    bucket = (sig >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sig), np.int64)
    order = np.argsort(bucket, kind="stable")
    sig, entry, bucket = (sig[order] << U64(bits)) >> U64(24), entry[order], bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    names, blocks = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        e = entry[a:b]
        run = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
        counts = np.diff(np.append(run, b - a)).astype("<u4")
        low = sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        blocks.append(np.uint32(len(run)).tobytes() + e[run].astype("<u8").tobytes() + counts.tobytes() + low.tobytes())
        names.append(int(bucket[a]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(block, "<u4", 1)[0])
    entries = np.frombuffer(block, "<u8", n, 4)
    counts = np.frombuffer(block, "<u4", n, 4 + 8 * n)
    low = np.frombuffer(block, np.uint8, -1, 4 + 12 * n).reshape(-1, 5)
    sig = np.zeros((len(low), 8), np.uint8)
    sig[:, :5] = low
    return sig.view("<u8").ravel(), np.repeat(entries, counts)


class _Bucket:
    """Posting lists of one bucket.  Members of lists that outgrow ``LONG_LIST`` are
    passed on at once, so what is held does not grow with the commonest subsets.  Rows out:
    members of short (kind 0) and of long lists (kind 3), and per entry how many of its
    subsets lie on long (kind 1) and on short lists of two or more (kind 2), the number in
    ``list_id``."""

    def __init__(self, number: int):
        self.number, self.parts, self.rows, self.limit = number, [], 0, 2 * BUCKET_ROWS
        self.long = np.zeros(0, U64)

    def _sorted(self):
        sig, entry = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((entry, sig))
        sig, entry = sig[order], entry[order]
        keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (entry[1:] != entry[:-1])))
        sig, entry = sig[keep], entry[keep]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.append(start, len(sig)))
        return sig, entry, start, count

    def add(self, block: bytes):
        part = _unpack(block)
        self.parts.append(part)
        self.rows += len(part[0])
        if self.rows < self.limit:
            return
        sig, entry, start, count = self._sorted()
        long = np.repeat((count > LONG_LIST) | np.isin(sig[start], self.long), count)
        self.long = np.union1d(self.long, sig[long])
        self.parts, self.rows = [(sig[~long], entry[~long])], int((~long).sum())
        self.limit = max(2 * BUCKET_ROWS, 2 * self.rows)
        yield from self._skipped(sig[long], entry[long])

    def _skipped(self, sig: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
        """How many subsets of each entry lie on long lists (kind 1) and which (kind 3)."""
        own, times = np.unique(entry, return_counts=True)
        yield self._rows(1, times.astype(U64), own)
        yield self._rows(3, mix(sig | U64(self.number << 40)), entry)

    def _rows(self, kind: int, lists: np.ndarray, entry: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(lists), kind, np.int8)), pa.array(lists.view(np.int64)),
            pa.array(entry.view(np.int64))], names=["kind", "list_id", "entry"])

    def close(self):
        sig, entry, start, count = self._sorted()
        long = (count > LONG_LIST) | np.isin(sig[start], self.long)
        at = np.repeat(long, count)
        yield from self._skipped(sig[at], entry[at])
        own, times = np.unique(entry[np.repeat((count >= 2) & ~long, count)], return_counts=True)
        yield self._rows(2, times.astype(U64), own)
        # equal lists of several subsets are one list, named by its members
        name = np.add.reduceat(mix(entry | U64(1)), start) if len(start) else sig
        short = np.flatnonzero((count >= 2) & ~long)
        _, once = np.unique(name[short], return_index=True)
        pick = np.zeros(len(start), bool)
        pick[short[once]] = True
        at = np.repeat(pick, count)
        yield self._rows(0, np.repeat(name, count)[at], entry[at])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket = None
    for batch in batches:
        for number, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket is None or bucket.number != number:
                if bucket is not None:
                    yield from bucket.close()
                bucket = _Bucket(number)
            yield from bucket.add(block.as_py())
    if bucket is not None:
        yield from bucket.close()


def _deletions(scheme: Scheme, k: int):
    """One-deletion neighbourhoods for texts marked with the slots to index: per segment
    its subset and the subset without each hash.  Only segments of two hashes or more
    are counted on in the ``roomy`` cut, each lost by two differences at least; a single
    hash is indexed as what a segment of two may lose one hash to.  Where no more than H/2
    can be counted on, the tightest cut is indexed as well, with every segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, want, ids = (batch.column(c).to_numpy() for c in (1, 2, 3))
            for lo, hi, data, offsets in text_slices(batch.column(0)):
                s = Sets(data, offsets, k)
                right = s.key.view(np.int64) == want[lo:hi]
                for slot in (0, 1):
                    use, band = _slot(s, scheme, slot)
                    use = use & right & ((slots[lo:hi] >> slot) & 1).astype(bool)
                    if not use.any():
                        continue
                    doc, _, start, end, _ = s.segments(use, scheme.roomy[band], band)
                    usable = np.bincount(doc[end - start >= 2], minlength=hi - lo)
                    spare = usable - scheme.differ(s.size, band, slot) // 2
                    yield _neighbours(s, use, scheme.roomy[band], band + 1_000, 1, spare, ids[lo:hi])
                    tight = use & (spare <= 0)
                    if tight.any():
                        yield _neighbours(s, tight, scheme.pairs[band], band + 2_000, 0, np.ones_like(spare), ids[lo:hi])
    return run


def _neighbours(s: Sets, use: np.ndarray, count: np.ndarray, salt: np.ndarray, least: int, spare: np.ndarray,
                ids: np.ndarray) -> pa.RecordBatch:
    doc, label, start, end, mixed = s.segments(use, count, salt)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mixed, dtype=U64)))
    whole = total[end] - total[start]
    less = end - start > least  # a subset must keep ``least`` hashes
    per = np.where(less, end - start, 0)
    each = np.repeat(less, end - start)
    sig = [mix(whole ^ label), mix((np.repeat(whole, per) - mixed[each]) ^ np.repeat(label, per))]
    owner = [doc, np.repeat(doc, per)]
    cell = [label, np.repeat(label, per)]
    if least == 0:  # empty segments match each other and single-hash ones
        for d in np.flatnonzero(use).tolist():
            filled = np.zeros(int(count[d]), bool)
            seg = ((s.hash[s.first[d]:s.first[d + 1]] >> U64(HASH_BITS - 32)) * U64(count[d])) >> U64(32)
            filled[seg.astype(np.int64)] = True
            empty = np.flatnonzero(~filled).astype(U64)
            cell.append(mix(U64(salt[d]) * U64(1 << 32) + empty))
            sig.append(mix(cell[-1]))
            owner.append(np.full(len(empty), d))
    sig, owner, cell = np.concatenate(sig), np.concatenate(owner), np.concatenate(cell)
    return pa.RecordBatch.from_arrays([
        pa.array(sig.view(np.int64)), pa.array(s.key[owner].view(np.int64)), pa.array(ids[owner], pa.int64()),
        pa.array(salt[owner], pa.int32()), pa.array(cell.view(np.int64)), pa.array(spare[owner], pa.int32())],
        names=["list_id", "key", "id", "cut", "cell", "spare"])


def _sketch_filter(scheme: Scheme):
    """Pairs whose sizes and sketches allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH_BYTES) for c in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            ok = (apart * (scheme.den + scheme.num) <= (scheme.den - scheme.num) * (n + m)) \
                & (np.minimum(n, m) * scheme.den >= np.maximum(n, m) * scheme.num)
            yield batch.select([0, 1]).filter(pa.array(ok))
    return run


def _cross(scheme: Scheme):
    """Rows sorted by (list, chunk, role): members outside the list's largest component
    (role 0), then a chunk of all its members (role 1).  Yields the pairs across
    components whose sizes and sketches allow a link."""
    def pairs(minor, part) -> np.ndarray:
        found = []
        step = max(1, (1 << 16) // max(1, len(part[0])))
        for lo in range(0, len(minor[0]), step):
            own = [x[lo:lo + step] for x in minor]
            small, large = np.minimum(own[2][:, None], part[2]), np.maximum(own[2][:, None], part[2])
            i, j = np.nonzero((own[1][:, None] != part[1]) & (small * scheme.den >= large * scheme.num))
            apart = np.bitwise_count(own[3][i] ^ part[3][j]).sum(axis=1, dtype=np.int64)
            ok = apart * (scheme.den + scheme.num) <= (scheme.den - scheme.num) * (own[2][i] + part[2][j])
            x, y = own[0][i[ok]], part[0][j[ok]]
            found.append(np.column_stack((np.minimum(x, y), np.maximum(x, y))))
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, minor = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, chunk, role, ids, comp, n = (batch.column(c).to_numpy() for c in range(6))
            sketch = np.frombuffer(b"".join(batch.column(6).to_pylist()), U64).reshape(batch.num_rows, -1)
            edge = np.flatnonzero(np.concatenate(([True], (lists[1:] != lists[:-1]) | (chunk[1:] != chunk[:-1]) | (role[1:] != role[:-1]), [True])))
            found = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if (lists[a], chunk[a]) != group:
                    group, minor = (lists[a], chunk[a]), []
                rows = (ids[a:b], comp[a:b], n[a:b], sketch[a:b])
                if role[a] == 0:
                    minor.append(rows)
                elif minor:
                    found.append(pairs(tuple(np.concatenate(x) for x in zip(*minor)), rows))
            out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])
    return run


def _verify(scheme: Scheme, k: int):
    """Rows sorted by (centre, salt, role): the centre's texts come first, its partners
    follow.  Texts whose set is not the wanted class (rows that repeat a doc_id) pass by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centres = None, []
        for batch in batches:
            centre, salt, role, ids, want = (batch.column(c).to_numpy() for c in range(5))
            left, right = [], []
            for lo, hi, data, offsets in text_slices(batch.column(5)):
                s = Sets(data, offsets, k)
                for j in range(lo, hi):
                    if (centre[j], salt[j]) != group:
                        group, centres = (centre[j], salt[j]), []
                    if s.key[j - lo].view(np.int64) != want[j]:
                        continue
                    own = s.hash[s.first[j - lo]:s.first[j - lo + 1]]
                    if role[j] == 0:
                        centres.append(own.copy())
                        continue
                    for other in centres:
                        both = _common(own, other)
                        if both * scheme.den >= scheme.num * (len(own) + len(other) - both):
                            left.append(centre[j])
                            right.append(ids[j])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _pairs_of(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def link_components(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(per document, links).

    The first has doc_id, n_shingles, class_id (smallest doc_id of its exact-copy class),
    component_id; one row per row of ``docs``.  The second has the links a < b between
    classes that were found on the way to the components (enough to connect each)."""
    spark = docs.sparkSession
    scheme = Scheme(num, den)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heads = written(rows.mapInArrow(_headers(scheme, k),
                    "doc_id long, n_shingles long, key long, check long, spare0 long, spare1 long, sketch binary"), "join-heads")
    named = heads.where("n_shingles > 0 and doc_id is not null")
    classes = written(named.groupBy("key", "check", "n_shingles").agg(
        F.min("doc_id").alias("id"), F.first("spare0").alias("spare0"), F.first("spare1").alias("spare1"),
        F.first("sketch").alias("sketch")), "join-classes")

    expected = classes.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, 0.5 * expected / BUCKET_ROWS))))
    blocks = rows.where("doc_id is not null").select("text").mapInArrow(_blocks(scheme, k, bits), "bucket int, block binary")
    posted = written(blocks.repartition("bucket").sortWithinPartitions("bucket")
                     .mapInArrow(_lists, "kind byte, list_id long, entry long"), "join-lists")

    entries = classes.select("key", "id", F.explode(F.array(
        F.struct(F.lit(0).alias("slot"), F.col("spare0").alias("spare")),
        F.struct(F.lit(1).alias("slot"), F.col("spare1").alias("spare")))).alias("e")).where("e.spare is not null") \
        .select("key", "id", F.col("e.slot").alias("slot"), F.col("e.spare").alias("spare"),
                F.col("key").bitwiseOR(F.col("e.slot").cast("long")).alias("entry"))
    met = posted.where("kind in (1, 2)").groupBy("entry").agg(
        F.sum("list_id").alias("met"), F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("list_id"))), F.lit(0)).alias("skipped"))
    # count filter: a linked pair agrees on ``spare`` subsets or more, so an entry that meets
    # others on fewer has no link under its scheme
    hopeful = written(entries.join(met, "entry", "left").select(
        "entry", "key", "id", "slot", "spare", F.coalesce("met", F.lit(0)).alias("met"), F.coalesce("skipped", F.lit(0)).alias("skipped"))
        .where("met >= spare"), "join-entries")
    # usable subsets on short lists must exceed the differences, or long lists are needed too
    needy = hopeful.where("spare - skipped <= 0").select("entry", "id", "key", "slot", "spare")
    # the texts that anything below reads are dealt out once, alike at every size
    wanted = hopeful.select("id", "key").distinct()
    texts = written(rows.join(wanted.hint("merge"), rows.doc_id == wanted.id).select("id", "key", "text"), "join-texts")
    info = classes.select("id", "n_shingles", "sketch").join(wanted.select("id").distinct(), "id", "left_semi")

    def linked(pairs: DataFrame, name: str, checked: bool) -> DataFrame:
        x, y = info.toDF("a", "n_a", "s_a"), info.toDF("b", "n_b", "s_b")
        likely = pairs if checked else written(pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
                                               .mapInArrow(_sketch_filter(scheme), "a long, b long").distinct(), f"{name}-pairs")
        # a centre with many partners is repeated per 256 of them, so no task holds them all
        parts = likely.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("parts"))
        dealt = likely.join(parts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        asked = dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id")).unionByName(
            dealt.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id")).distinct())
        sorted_rows = asked.join(texts, "id").select("a", "salt", "role", "id", "key", "text") \
            .repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
        return written(sorted_rows.mapInArrow(_verify(scheme, k), "a long, b long").distinct(), f"{name}-links")

    def star(current: DataFrame, order) -> DataFrame:
        centre = current.groupBy("list_id").agg(F.min_by("id", order).alias("c"), F.min_by("component_id", order).alias("cc"))
        return current.join(centre, "list_id").where("component_id <> cc").select(*_pairs_of(F.col("id"), F.col("c"))).distinct()

    links, component, tested, usable = None, None, None, None
    # a linked pair that meets on no short list consists of two needy entries, on long ones
    held = written(posted.where("kind = 3").select("list_id", "entry")
                   .join(needy.select("entry", "id", "key"), "entry").distinct(), "join-long")
    if not held.isEmpty():
        tested = written(star(held.withColumn("component_id", F.col("id")), F.col("id")), "join-long-star")
        links = linked(tested, "join-long", checked=False)
        outside = written(held.join(graph.components(links), "id", "left")
                          .groupBy("list_id", F.coalesce("component_id", "id").alias("component_id")).agg(F.count("*").alias("c"))
                          .groupBy("list_id").agg((F.sum("c") - F.max("c")).alias("outside")), "join-long-outside")
        usable = held.join(outside.where(F.col("outside").between(1, OUTSIDE)), "list_id").select("list_id", "id", "key")
        dear = held.join(outside.where(F.col("outside") > OUTSIDE), "list_id").groupBy("entry").agg(F.count("*").alias("dear"))
        needy = needy.join(dear, "entry", "left").where("spare <= coalesce(dear, 0)")
    slots = needy.groupBy("id", "key").agg(F.expr("cast(bit_or(shiftleft(1, slot)) as int)").alias("slots"))
    near = written(texts.join(slots, ["id", "key"]).select("text", "slots", "key", "id").mapInArrow(
        _deletions(scheme, k), "list_id long, key long, id long, cut int, cell long, spare int").distinct(), "join-deletions")
    by_list, by_cut = Window.partitionBy("list_id"), Window.partitionBy("id", "key", "cut")
    meeting = near.withColumn("low", F.min("key").over(by_list)).withColumn("high", F.max("key").over(by_list)).where("low < high")
    # the count filter again; a set has no more cells than hashes
    meeting = meeting.withColumn("cells", F.size(F.collect_set("cell").over(by_cut))).where("cells >= spare")
    # equal lists are named without slots, so a kept list stands for those of its classes' other slots
    members = posted.where("kind = 0").select("list_id", F.col("entry").bitwiseAND(F.lit(-2)).alias("key")) \
        .join(wanted, "key").select("list_id", "id", "key").unionByName(
        meeting.select("list_id", "id", "key"))
    if usable is not None:
        members = members.unionByName(usable)
    members = members.distinct()
    lists = written(members, "join-members")

    open_lists = lists.select("list_id", "id")
    for turn in range(STAR_TURNS + 1):
        if turn == 0:
            current = open_lists.withColumn("component_id", F.col("id"))
        else:
            current = open_lists.join(component, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
            state = current.groupBy("list_id").agg(
                F.count("*").alias("size"), F.min("component_id").alias("x"), F.max("component_id").alias("y"))
            unsettled = state.where("x < y and size > 2").select("list_id")
            current = written(current.join(unsettled, "list_id"), f"join-open{turn}")
            if current.isEmpty():
                break
            open_lists = current.select("list_id", "id")
        if turn < STAR_TURNS:
            order = F.col("id") if turn == 0 else F.xxhash64(F.col("id"), F.lit(turn))
            pairs = star(current, order)
        else:
            per = current.groupBy("list_id", "component_id").agg(F.count("*").alias("c")).groupBy("list_id").agg(
                F.max_by("component_id", "c").alias("main"), F.ceil(F.sum("c") / CHUNK).alias("chunks"))
            rows_of = current.join(per, "list_id").join(info, "id")
            data = ["id", "component_id", "n_shingles", "sketch"]
            every = rows_of.select("list_id", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), F.lit(1).alias("role"), *data)
            minor = rows_of.where("component_id <> main").select(
                "list_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), *data)
            pairs = every.unionByName(minor).repartition("list_id", "chunk").sortWithinPartitions("list_id", "chunk", "role") \
                .mapInArrow(_cross(scheme), "a long, b long").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, f"join-turn{turn}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = linked(pairs, f"join-turn{turn}", checked=turn == STAR_TURNS)
        links = found if links is None else links.unionByName(found)
        component = graph.components(links)

    keyed = classes.join(component, "id", "left").select(
        "key", "check", "n_shingles", F.col("id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))
    full = heads.select("doc_id", "n_shingles", "key", "check").join(keyed, ["key", "check", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return full.select("doc_id", "n_shingles",
                       F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
                       own.alias("component_id")), links
