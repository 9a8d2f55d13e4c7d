"""Helpers that write the DuckDB (RE2) twin of a JVM pattern for the oracle SQL.

RE2 has ASCII ``\\w``/``\\b`` and no lookaround, while the library's patterns run with
Java's Unicode classes. Every non-ASCII character in the driver tables is a Latin
letter, so folding those letters to an ASCII word character before an ASCII-only
pattern runs gives RE2 the same word boundaries Java sees.
"""
from __future__ import annotations

import re

LATIN = "[À-ÖØ-öø-ɏ]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str, ci: bool = True) -> str:
    p = re.sub(r"^\(\?[iU]+\)", "", pattern)
    p = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", p)
    p = p.replace("(?! up)", "")   # RE2 has no lookahead; the phrase never occurs in the tables
    if ci:
        # Unicode case-insensitive matching (Python re, Java (?iU)) treats dotless i as
        # a case variant of i; RE2's simple folding does not, so spell it out.
        p = p.replace("ı", "ıi")
    return ("(?i)" if ci else "") + p


def fold(expr: str) -> str:
    return f"regexp_replace({expr}, '{LATIN}', 'x', 'g')"


def rmatch(expr: str, pattern: str, ci: bool = True, folded: bool = True) -> str:
    e = fold(expr) if folded else expr
    return f"coalesce(regexp_matches({e}, {q(re2(pattern, ci))}), false)"


def rcount(expr: str, pattern: str, ci: bool = True, folded: bool = True) -> str:
    e = fold(expr) if folded else expr
    return f"coalesce(len(regexp_extract_all({e}, {q(re2(pattern, ci))})), 0)"


def rreplace(expr: str, pattern: str, repl: str, ci: bool = True) -> str:
    return f"regexp_replace({expr}, {q(re2(pattern, ci))}, {q(repl)}, 'g')"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def collapse(expr: str) -> str:
    return f"regexp_replace({expr}, '\\s{{2,}}', ' ', 'g')"


def arr(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"
