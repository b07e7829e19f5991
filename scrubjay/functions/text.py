"""Column expressions for the text rules: normalization, checkpoint detection and
signatures, markers.  All are built-in JVM expressions (regexp_replace, md5, concat),
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .regex import SPACE_ITEMS, any_of, portable_regex

# Variable parts removed by normalization, in this order.
NORMALIZE_DROP_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}:\d{2}:\d{2}",
    r"ID:\s*\d+",
    r"#\d+",
]

# Default checkpoint patterns (searched case-insensitively).
CHECKPOINT_PATTERNS = [
    r"CHECKPOINT\s+\w+\s+\w+\s+\d+\s+\d+:\d+:\d+\s+\w+\s+\d+:\s+auto-sync",
    r"Sincronización automática cada \d+ min",
    r"auto-sync - Sincronización automática",
    r"SYNC:\s*\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}",
    r"Checkpoint\s+\d+\s+completed",
    r"Auto-save\s+at\s+\d{4}-\d{2}-\d{2}",
]
# The shorter list used when no configuration is given at all.
CHECKPOINT_PATTERNS_BASIC = CHECKPOINT_PATTERNS[:3]

# Masks applied (case-sensitively) to build a checkpoint signature.
SIGNATURE_MASKS = [
    (r"\w+\s+\w+\s+\d+\s+\d+:\d+:\d+\s+\w+\s+\d+", "TIMESTAMP"),
    (r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}", "DATETIME"),
    (r"\d{2}:\d{2}:\d{2}", "TIME"),
    (r"\d+", "NUM"),
]

# Substrings the monitor counts (case-sensitive LIKE).
MONITOR_CHECKPOINT_SUBSTRINGS = ["CHECKPOINT", "auto-sync", "checkpoint"]
PROCESSED_SUBSTRINGS = ["[CONSOLIDATED]", "[ARCHIVED", "[MERGED", "[DUPLICATE"]

STRIP_REGEX = rf"\A[{SPACE_ITEMS}]+|[{SPACE_ITEMS}]+\z"
SPACE_RUN_REGEX = portable_regex(r"\s+")
PUNCT_REGEX = portable_regex(r"[^\w\s]")
#: Java passes over the commonest characters by a bit set before it asks for Unicode classes.
UNCOMMON = "(?=[^ abcdefghijklmnopqrstuvwxyz])"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of ``SPACE_ITEMS``, one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def py_strip(c) -> Column:
    """``str.strip()``: trims every Unicode whitespace character, not just spaces."""
    return F.btrim(_col(c), F.lit(SPACES))


def normalize_text(c) -> Column:
    """lower -> strip -> drop dates, times, ``ID: n``, ``#n`` -> collapse whitespace ->
    drop punctuation -> strip.  The ``ID:`` rule can never fire (the text is already
    lower case) and spaces are collapsed before punctuation goes, so ``a - b`` becomes
    ``a  b``; both are kept for identical results."""
    x = py_strip(F.lower(_col(c)))
    for p in NORMALIZE_DROP_PATTERNS:
        x = F.regexp_replace(x, portable_regex(p), "")
    x = F.regexp_replace(x, SPACE_RUN_REGEX, " ")
    x = F.regexp_replace(x, UNCOMMON + PUNCT_REGEX, "")
    return py_strip(x)


def word_set(norm) -> Column:
    """Distinct words of a normalized text (``set(norm.split())``)."""
    return F.array_distinct(F.filter(F.split(_col(norm), " "), lambda w: w != ""))


def is_checkpoint(c, patterns=None) -> Column:
    """Case-insensitive search for any checkpoint pattern; NULL text is not a checkpoint."""
    rx = any_of(patterns or CHECKPOINT_PATTERNS, ignore_case=True, dialect="java")
    return F.coalesce(_col(c).rlike(rx), F.lit(False))


def masked_checkpoint(c) -> Column:
    x = _col(c)
    for p, repl in SIGNATURE_MASKS:
        x = F.regexp_replace(x, portable_regex(p), repl)
    return x


def checkpoint_signature(c) -> Column:
    """MD5 hex of the masked text (UTF-8 bytes)."""
    return F.md5(masked_checkpoint(c))


def contains_any(c, needles) -> Column:
    cond = None
    for s in needles:
        term = _col(c).contains(s)
        cond = term if cond is None else (cond | term)
    return F.coalesce(cond, F.lit(False))


def monitor_checkpoint_like(c) -> Column:
    return contains_any(c, MONITOR_CHECKPOINT_SUBSTRINGS)


def is_processed(c) -> Column:
    return contains_any(c, PROCESSED_SUBSTRINGS)


def ts_text(c, with_seconds: bool = True) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss" if with_seconds else "yyyy-MM-dd HH:mm")


# Marker formats appended to resolved rows.
def keep_latest_marker(kept_id) -> Column:
    return F.concat(F.lit(" [DUPLICATE - KEPT ID: "), _col(kept_id).cast("string"), F.lit("]"))


def merged_into_marker(primary_id) -> Column:
    return F.concat(F.lit(" [MERGED INTO ID: "), _col(primary_id).cast("string"), F.lit("]"))


def group_marker(group_id) -> Column:
    return F.concat(F.lit(" [DUPLICATE GROUP: "), _col(group_id).cast("string"), F.lit("]"))


CONSOLIDATED_MARKER = " [CONSOLIDATED]"
