"""Rows that match any of many LIKE patterns, by one automaton over row batches.

A text that matches a pattern holds the pattern's longest run of plain characters.  The
runs of all patterns form an Aho-Corasick automaton, which finds those that a text holds
in one pass over it; LIKE then decides.  An automaton holds at most ``PATTERNS`` patterns
(the caller's patterns have a bounded length, so its broadcast has a bounded size); more
patterns take more passes over the rows.  Rows are not shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..plans.ordering import dense_index
from ..session import cut_lineage

PATTERNS = 50_000


def plain_run(pattern: str) -> str:
    """Longest run of characters between the wildcards of a LIKE pattern (escape: backslash)."""
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c in "%_":
            runs.append("")
        else:
            at += c == "\\"
            runs[-1] += pattern[at:at + 1]
        at += 1
    return max(runs, key=len)


def _automaton(patterns: list[tuple[int, str]]):
    """(automaton or None, numbers of each run, numbers of patterns without a run)."""
    import ahocorasick

    by_run: dict[str, list[int]] = {}
    for number, pattern in patterns:
        by_run.setdefault(plain_run(pattern), []).append(number)
    always = by_run.pop("", [])
    if not by_run:
        return None, by_run, always
    out = ahocorasick.Automaton()
    for run in by_run:
        out.add_word(run, run)
    out.make_automaton()
    return out, by_run, always


def _searched(patterns, content_col: str):
    def run(batches):
        automaton, by_run, always = _automaton(patterns.value)
        for batch in batches:
            hits = []
            for text in batch.column(batch.schema.get_field_index(content_col)).to_pylist():
                if text is None:
                    hits.append([])
                    continue
                runs = {found for _, found in automaton.iter(text)} if automaton is not None else ()
                hits.append(always + [n for r in runs for n in by_run[r]])
            keep = pa.array([bool(h) for h in hits])
            columns = [*batch.columns, pa.array(hits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_hits"]).filter(keep)
    return run


def matching_rows(rows: DataFrame, patterns: DataFrame, content_col: str = "content") -> DataFrame:
    """The columns of ``rows`` and of ``patterns`` for every row and LIKE pattern (column
    ``pattern``) that its text matches; null texts match nothing, equal patterns count each."""
    numbered = cut_lineage(dense_index(patterns, [F.col(c) for c in patterns.columns], "_number"))
    total, spark = numbered.count(), rows.sparkSession
    schema = StructType([*rows.schema.fields, StructField("_hits", ArrayType(LongType()))])
    found = None
    for lo in range(0, max(total, 1), PATTERNS):
        some = numbered.where((F.col("_number") >= lo) & (F.col("_number") < lo + PATTERNS))
        listed = spark.sparkContext.broadcast([(r._number, r.pattern) for r in some.select("_number", "pattern").collect()])
        hits = rows.mapInArrow(_searched(listed, content_col), schema).withColumn("_number", F.explode("_hits"))
        own = hits.join(F.broadcast(some), "_number").where(F.expr(f"`{content_col}` LIKE pattern"))
        own = own.drop("_hits", "_number")
        found = own if found is None else found.unionByName(own)
    return found
