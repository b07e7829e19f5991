"""Removal of long repeated word passages (operator 9).

A window is ``window`` consecutive words of one document; a word goes if a window over
it also starts in a document with a smaller ``doc_id``.

*Routing.*  A window's fingerprint is the smallest hash among its word ``gram``-s, so
equal windows have equal fingerprints wherever they stand.  Consecutive windows with one
fingerprint form a segment; only segments whose fingerprint occurs in two documents go
on.  Equal segments are collapsed before any text moves.

*Suffix automata.*  The different segments of one fingerprint form reference shards of
at most ``SHARD`` segments.  A shard's suffix automaton takes its segments in ascending
``doc_id`` order and every segment of the fingerprint streams through every shard's
automaton before larger documents enter it: where the matching statistic (the longest
suffix that occurs in the automaton) reaches ``window``, that window occurs in a smaller
document.  Only windows that were not matched enter, so an automaton grows with the new
text of its shard and never beyond ``SHARD`` segments, however common the passage.

Edge cases: null, empty and blank texts have no words; texts shorter than a window keep
every word; windows are judged on the input; rows that repeat a ``doc_id`` are one
document and never remove each other; rows with a null ``doc_id`` stand outside the order
and keep every word.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import written
from scrubjay.llm.textkernel import U64, Words, _power_tables, grams, mix, text_slices, words

GRAM = 8
SHARD = 1024
SPANS = "array<struct<start:int,end:int>>"


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (block prefix and suffix minima)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def segments(w: Words, window: int):
    """(document place, fingerprint, content hash, first window, windows) of each run of
    consecutive windows with one fingerprint; windows count from the document's start."""
    low = _window_minima(grams(w, GRAM), window - GRAM + 1)
    n = len(low)
    doc = np.repeat(np.arange(len(w.bounds) - 1), w.counts)[:n]
    valid = np.flatnonzero(np.arange(n) + window <= w.bounds[1:][doc]) if n else np.zeros(0, np.int64)
    if not len(valid):
        z = np.zeros(0, np.int64)
        return z, z.astype(U64), z.astype(U64), z, z
    fp, d = low[valid], doc[valid]
    first = np.flatnonzero(np.concatenate(([True], (fp[1:] != fp[:-1]) | (d[1:] != d[:-1]))))
    count = np.diff(np.append(first, len(valid)))
    start = valid[first]
    up, down = _power_tables(len(w.hashes) + 1)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(w.hashes * up[:len(w.hashes)], dtype=U64)))
    content = mix((sums[start + count + window - 1] - sums[start]) * down[start] + count.astype(U64))
    return d[first], fp[first], content, start - w.bounds[d[first]], count


def _occurrences(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                d, fp, content, start, count = segments(words(data, offsets), window)
                at = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(fp.view(np.int64)),
                    pa.array(content.view(np.int64)), pa.array(start, pa.int32()), pa.array(count, pa.int32())],
                    names=["doc_id", "version", "fp", "content", "start", "windows"])
    return run


def _segment_words(window: int):
    """Word hashes of the wanted segments of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column(0)):
                w = words(data, offsets)
                rows = [(s["fp"], s["content"], s["windows"], w.hashes[at:at + s["windows"] + window - 1].tobytes())
                        for i in range(lo, hi) for s in wanted[i] for at in (w.bounds[i - lo] + s["start"],)]
                for k in range(0, len(rows), 2000):
                    fp, content, count, own = zip(*rows[k:k + 2000])
                    yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(content, pa.int64()), pa.array(count, pa.int32()),
                                                      pa.array(own, pa.binary())], names=["fp", "content", "windows", "words"])
    return run


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state reached from ``state`` by ``word`` for exactly length + 1 words."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            state = last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, word)
            last = new

    def matched(self, sequence: list[int], window: int) -> list[int]:
        """First words of the windows of ``sequence`` that occur in the automaton."""
        found, state, size = [], 0, 0
        moves, link, length = self.next, self.link, self.length
        for end, word in enumerate(sequence, 1):
            while state and word not in moves[state]:
                state = link[state]
                size = length[state]
            if word in moves[state]:
                state = moves[state][word]
                size += 1
            if size >= window:
                found.append(end - window)
        return found


def _runs(places: list[int], window: int) -> list[dict[str, int]]:
    """Word ranges covered by windows that start at ``places`` (ascending)."""
    out: list[dict[str, int]] = []
    for p in places:
        if out and p <= out[-1]["end"]:
            out[-1]["end"] = p + window
        else:
            out.append({"start": p, "end": p + window})
    return out


def _match(window: int):
    """Rows sorted by (fp, shard, doc_id): matching statistics of each segment against
    the shard's automaton of smaller documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, doc, automaton, waiting = None, None, None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["fp"], row["shard"]) != group:
                    group, doc, automaton, waiting = (row["fp"], row["shard"]), row["doc_id"], SuffixAutomaton(), []
                if row["doc_id"] != doc:
                    for part in waiting:
                        automaton.add(part)
                    doc, waiting = row["doc_id"], []
                sequence = np.frombuffer(row["words"], U64).tolist()
                found = automaton.matched(sequence, window) if len(automaton.link) > 1 else []
                if row["home"]:
                    new = sorted(set(range(row["windows"])).difference(found))
                    edges = [i for i in range(len(new)) if i == 0 or new[i] != new[i - 1] + 1] + [len(new)]
                    waiting += [sequence[new[a]:new[b - 1] + window] for a, b in zip(edges, edges[1:])]
                if found:
                    out.append((row["fp"], row["content"], row["windows"], _runs(found, window)))
            fp, content, count, spans = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                pa.array(fp, pa.int64()), pa.array(content, pa.int64()), pa.array(count, pa.int32()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["fp", "content", "windows", "found"])
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, version, spans): word ranges [start, end) to remove, for the documents
    that have any; ``version`` is xxhash64 of the text, for rows that repeat a doc_id."""
    rows = _keyed(docs).where("doc_id is not null")
    every = written(rows.mapInArrow(_occurrences(window),
                    "doc_id long, version long, fp long, content long, start int, windows int"), "repeat-all")
    spread = every.groupBy("fp").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("fp")
    found = written(every.join(spread, "fp"), "repeat-shared")
    same = ["fp", "content", "windows"]
    kinds = written(found.groupBy(*same).agg(F.min("doc_id").alias("first")), "repeat-kinds")

    many = kinds.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1") \
        .select("fp", F.ceil(F.col("kinds") / SHARD).cast("int").alias("shards"))
    ask = kinds.join(many, "fp")
    # one place of each different segment, in its smallest document
    place = found.join(ask, same).where("doc_id = first").groupBy(*same, "doc_id").agg(
        F.min(F.struct("version", "start")).alias("p")).select(*same, "doc_id", "p.version", "p.start")
    wanted = place.groupBy("doc_id", "version").agg(F.collect_list(F.struct("fp", "content", "windows", "start")).alias("wanted"))
    taken = rows.join(wanted, ["doc_id", "version"]).select("text", "wanted").mapInArrow(
        _segment_words(window), "fp long, content long, windows int, words binary").dropDuplicates(same)
    streams = taken.join(ask, same).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(
        *same, F.col("first").alias("doc_id"), "shard",
        (F.pmod(F.xxhash64("content"), F.col("shards")) == F.col("shard")).alias("home"), "words")
    hits = written(streams.repartition("fp", "shard").sortWithinPartitions("fp", "shard", "doc_id", "content")
                   .mapInArrow(_match(window), f"fp long, content long, windows int, found {SPANS}"), "repeat-hits")

    whole = found.join(kinds, same).where("doc_id > first").select(
        "doc_id", "version", F.col("start"), (F.col("start") + F.col("windows") + (window - 1)).alias("end"))
    part = found.join(kinds, same).where("doc_id = first").join(hits, same).select(
        "doc_id", "version", F.col("start").alias("at"), F.explode("found").alias("f")).select(
        "doc_id", "version", (F.col("at") + F.col("f.start")).alias("start"), (F.col("at") + F.col("f.end")).alias("end"))
    return whole.unionByName(part).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _keep(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(2)
        for lo, hi, data, offsets in text_slices(batch.column(1)):
            w = words(data, offsets)
            edge = np.zeros(len(w.hashes) + 1, np.int64)
            own = spans.slice(lo, hi - lo)
            per = own.value_lengths().fill_null(0).to_numpy()
            flat = own.flatten()
            if len(flat):
                base = np.repeat(w.bounds[:-1], per)
                np.add.at(edge, flat.field("start").to_numpy() + base, 1)
                np.add.at(edge, flat.field("end").to_numpy() + base, -1)
            stay = np.cumsum(edge)[:-1] == 0
            mask = np.zeros(len(data) + 1, np.int32)
            mask[w.starts[stay]] += 1
            mask[w.ends[stay]] -= 1
            keep = np.cumsum(mask)[:-1].astype(bool)
            out = np.append(data, np.uint8(32))
            gap = w.ends[stay]
            gap = gap[gap < len(data)]
            gap = gap[~np.isin(gap, offsets[1:])]
            out[gap] = 32
            keep[gap] = True
            kept = [out[a:b][keep[a:b]].tobytes().removesuffix(b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            removed = np.add.reduceat(np.append(~stay, False), np.append(w.bounds[:-1], len(stay)))[:-1] * (w.counts > 0) if hi > lo else []
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, hi - lo), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() if digest else x.decode() for x in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text"])


def _kept(docs: DataFrame, window: int, digest: bool) -> DataFrame:
    rows, spans = _keyed(docs), written(repeated_spans(docs, window), "repeat-spans")
    joined = rows.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lambda batches: _keep(batches, digest),
                             f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the text that stays, its words joined by single spaces."""
    return _kept(docs, window, False)


def removal_digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """As :func:`remove_repeats` with the SHA-256 of the kept text in its place."""
    return _kept(docs, window, True)
