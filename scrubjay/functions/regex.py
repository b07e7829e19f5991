"""Python-compatible regular expressions for the JVM (and for RE2 in the DuckDB twins).

The rules the package reproduces were written for Python's ``re`` on ``str``, where
``\\d``, ``\\w`` and ``\\s`` are Unicode classes.  Java's are ASCII-only (``(?U)`` makes
``\\w`` too wide: combining marks), and RE2's ``\\s`` differs again.  We rewrite the three
shorthand classes into explicit Unicode classes that mean the same thing in Java and
RE2 as in Python.
"""

from __future__ import annotations

# The character classes that reproduce Python's str semantics.
DIGIT = r"\p{Nd}"
WORD_ITEMS = r"\p{L}\p{N}_"
SPACE_ITEMS = r"\t-\r\x1c-\x20\x85\p{Z}"


def portable_regex(pattern: str) -> str:
    """Rewrite ``\\d \\w \\s \\D \\W \\S`` of a Python pattern into portable classes."""
    out = []
    in_class = False
    i = 0
    n = len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt in "dws":
                items = {"d": DIGIT, "w": WORD_ITEMS, "s": SPACE_ITEMS}[nxt]
                out.append(items if in_class else (DIGIT if nxt == "d" else f"[{items}]"))
            elif nxt in "DWS":
                if in_class:
                    raise ValueError(f"negated class \\{nxt} inside [...] is not supported: {pattern!r}")
                items = {"D": DIGIT, "W": WORD_ITEMS, "S": SPACE_ITEMS}[nxt]
                out.append(f"[^{items}]")
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            i += 1
            # a leading ']' (or '^]') is a literal inside the class
            if i < n and pattern[i] == "^":
                out.append("^")
                i += 1
            if i < n and pattern[i] == "]":
                out.append("\\]")
                i += 1
            continue
        if ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def any_of(patterns, ignore_case: bool = False, dialect: str = "java") -> str:
    """One alternation for a list of patterns (search semantics, like ``re.search``)."""
    body = "|".join(f"(?:{portable_regex(p)})" for p in patterns)
    if not ignore_case:
        return body
    # Java's (?i) alone folds ASCII only; RE2 has no 'u' flag and folds Unicode by default.
    return ("(?iu)" if dialect == "java" else "(?i)") + body


def sql_quote(s: str) -> str:
    """Single-quoted SQL literal (no backslash processing in DuckDB strings)."""
    return "'" + s.replace("'", "''") + "'"
