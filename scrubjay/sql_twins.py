"""DuckDB twins of the Spark expressions, for the SQL oracle.

Built from the same fixed pattern lists as :mod:`scrubjay.functions.text`, so both
engines apply one rule set.  DuckDB's ``regexp_replace`` needs the ``'g'`` flag to
replace every match, and its regex engine (RE2) takes ``(?i)`` for Unicode case folding.
"""

from __future__ import annotations

from .functions.regex import any_of, portable_regex, sql_quote
from .functions.text import (CHECKPOINT_PATTERNS, MONITOR_CHECKPOINT_SUBSTRINGS,
                             NORMALIZE_DROP_PATTERNS, PROCESSED_SUBSTRINGS, SIGNATURE_MASKS,
                             SPACE_RUN_REGEX, PUNCT_REGEX, STRIP_REGEX)
from .sources.observations import ADAPTER_EPOCH


def rx_replace(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {sql_quote(pattern)}, {sql_quote(repl)}, 'g')"


def normalize(expr: str) -> str:
    x = rx_replace(f"lower({expr})", STRIP_REGEX, "")
    for p in NORMALIZE_DROP_PATTERNS:
        x = rx_replace(x, portable_regex(p), "")
    x = rx_replace(x, SPACE_RUN_REGEX, " ")
    x = rx_replace(x, PUNCT_REGEX, "")
    return rx_replace(x, STRIP_REGEX, "")


def is_checkpoint(expr: str, patterns=None) -> str:
    rx = any_of(patterns or CHECKPOINT_PATTERNS, ignore_case=True, dialect="re2")
    return f"coalesce(regexp_matches({expr}, {sql_quote(rx)}), false)"


def signature(expr: str) -> str:
    x = expr
    for p, repl in SIGNATURE_MASKS:
        x = rx_replace(x, portable_regex(p), repl)
    return f"md5({x})"


def contains_any(expr: str, needles) -> str:
    terms = " OR ".join(f"contains({expr}, {sql_quote(s)})" for s in needles)
    return f"coalesce(({terms}), false)"


def monitor_checkpoint_like(expr: str) -> str:
    return contains_any(expr, MONITOR_CHECKPOINT_SUBSTRINGS)


def is_processed(expr: str) -> str:
    return contains_any(expr, PROCESSED_SUBSTRINGS)


def py_fixed(expr: str, digits: int) -> str:
    """Python's ``format(x, '.Nf')`` (DuckDB's printf rounds the binary value the same way)."""
    return f"printf('%.{digits}f', {expr})"


def py_round(expr: str, digits: int) -> str:
    """Python's ``round(x, N)`` for doubles."""
    return f"CAST(printf('%.{digits}f', {expr}) AS DOUBLE)"


EPOCH = f"TIMESTAMP '{ADAPTER_EPOCH}'"

OBS_DOCUMENTS = f"""SELECT doc_id AS id, text AS content, {EPOCH} + to_minutes(doc_id) AS created_at,
  source AS entity_name, CAST(NULL AS TIMESTAMP) AS updated_at FROM documents"""

OBS_CONVERSATIONS = f"""SELECT conv_id * 100 + turn AS id, text AS content,
  {EPOCH} + to_minutes(conv_id * 100 + turn) AS created_at, role AS entity_name,
  CAST(NULL AS TIMESTAMP) AS updated_at FROM conversations"""

OBS_CHECKPOINTS = """SELECT event_id AS id,
  CASE event_type
    WHEN 'view' THEN 'SYNC: ' || strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 'click' THEN 'Checkpoint ' || CAST(event_id AS VARCHAR) || ' completed'
    WHEN 'error' THEN 'CHECKPOINT ' || strftime(ts, '%a %b %d %H:%M:%S') || ' UTC ' || strftime(ts, '%Y') || ': auto-sync'
    ELSE 'user ' || CAST(user_id AS VARCHAR) || ' ' || event_type || ' ' || props END AS content,
  CAST(ts AS TIMESTAMP) AS created_at, event_type AS entity_name,
  CAST(NULL AS TIMESTAMP) AS updated_at FROM events"""

SCAN_ORDER = "created_at DESC NULLS LAST, id DESC"
