"""Markup removal (X1): an ordered chain of regex replacements as one column expression.

The rules are data: ``(name, pattern, replacement)`` in application order, in
Python ``re`` syntax with MULTILINE semantics. ``java_rules`` converts them for
Spark (flags ``(?mdU)``: MULTILINE, only ``\\n`` ends a line, Unicode classes,
which is how Python treats ``str`` patterns) and ``duckdb_rules`` for RE2.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markup rules, in order (pattern, replacement, purpose).
MARKUP_RULES: tuple[tuple[str, str, str], ...] = (
    (r"\*\*([^*]+)\*\*", r"\1", "bold"),
    (r"__([^_]+)__", r"\1", "bold"),
    (r"\*([^*]+)\*", r"\1", "italic"),
    (r"_([^_]+)_", r"\1", "italic"),
    (r"\*\*\*([^*]+)\*\*\*", r"\1", "bold-italic"),
    (r"___([^_]+)___", r"\1", "bold-italic"),
    (r"~~([^~]+)~~", r"\1", "strikethrough"),
    (r">!([^!]+)!<", r"\1", "spoiler"),
    (r"\^\(([^)]+)\)", r"\1", "superscript (parentheses)"),
    (r"\^([^ ]+)", r"\1", "superscript"),
    (r"`([^`]+)`", r"\1", "code"),
    (r"r/([^ ]+)", r"", "subreddit"),
    (r"u/([^ ]+)", r"", "user"),
    (r"\[([^\]]+)\]\([^\)]+\)", r"\1", "inline link"),
    (r"\[([^\]]+)\]\[[^\]]+\]", r"\1", "reference link"),
    (r"\[(\d+)\]: [^\s]+", r"", "link definition"),
    (r"^(#+)\s*(.+)", r"\2", "heading"),
    (r"^\s*[-*]\s+", r"", "bullet"),
    (r"\d+\.\s+", r"", "numbered item"),
    (r"<([^_]+)>", r"", "web link"),
    (r"> ([^ ]+)", r"\1", "quote"),
    (r"[^\x00-\x7F]+", r"", "non-ASCII"),
    (r"&gt", r"", "entity"),
    (r"&lt", r"", "entity"),
    (r"&nbsp", r"", "entity"),
    (r"&amp", r"", "entity"),
    (r"(.)\1+", r"\1\1", "squeeze runs to two"),
    (r"\b(?!(?<!\w)(\d{2}|\d{4})(?!\w))\d+\b", r"", "numbers not of 2 or 4 digits"),
)

# Index of the one rule RE2 cannot run (a backreference in the pattern).
SQUEEZE_RULE = 26

# Same-result rewrites for Java that take linear time on hostile rows, as (pattern,
# replacement). Where an attempt fails, every later start in the stretch it has read would
# fail for the same reason (the same closing character is missing or followed by the same
# text), so a further alternative takes the whole stretch and puts it back ($2, $3): nothing
# is read again. Proved equal to the rule above by tests against Python ``re``.
_JAVA_FAST = {
    8: (r"\^\(([^)]+)\)|(\^\([^)]*+\z)", "$1$2"),
    13: (r"\[([^\]]++)\]\([^\)]+\)|(\[[^\]]*+\]\([^)]*+\z)|(\[[^\]]*+(?:\]|\z))", "$1$2$3"),
    14: (r"\[([^\]]++)\]\[[^\]]+\]|(\[[^\]]*+\]\[[^\]]*+\z)|(\[[^\]]*+(?:\]|\z))", "$1$2$3"),
    17: (r"^\s*+[-*]\s++|^(\s++)", "$1"),
    # A digit is read first, so other places are left at once; only a run's first digit goes on.
    18: (r"\d(?<!\d\d)\d*+\.\s+", ""),
    19: (r"<[^_]+>|(<[^_]*+)", "$1"),
    27: (r"\d(?<!\w\d)(?:\d{2}|\d{4,}+)?(?!\w)", ""),
}
# Rules written for ASCII text only: the general form runs where an earlier one is left out.
_AFTER = {27: 21}
# Substrings without which a rule cannot match: the rule is skipped for rows
# that lack them (a search of bytes instead of a regex scan). Each entry
# lists alternatives; an alternative is a tuple of substrings that must all occur.
# Neighbours with the same entry are skipped together.
_EMPHASIS = (("*",), ("_",))
_SIGNS = (("~~",), (">!",), ("^",), ("`",))
_NAMES = (("r/",), ("u/",))
_ENTITY = (("&",),)
_REQUIRES = {
    **{i: _EMPHASIS for i in range(6)},
    **{i: _SIGNS for i in range(6, 11)},
    11: _NAMES,
    12: _NAMES,
    13: (("](",),),
    14: (("][",),),
    15: (("]: ",),),
    16: (("#",),),
    17: (("-",), ("*",)),
    19: (("<", ">"),),
    20: (("> ",),),
    21: "beyond ASCII",
    **{i: _ENTITY for i in range(22, 26)},
}

# RE2 form of the last rule (no look-around): equal on ASCII text, which is all
# that reaches it.
_RE2_NUMBERS = r"\b(?:\d|\d{3}|\d{5,})\b"


def _java_replacement(rep: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", rep)


def java_rules(fast: bool = True, skip: tuple[int, ...] = ()) -> list[tuple[int, str, str]]:
    """(index, pattern, replacement) for Spark's ``regexp_replace``."""
    out = []
    for i, (pat, rep, _) in enumerate(MARKUP_RULES):
        if i in skip:
            continue
        quick = fast and i in _JAVA_FAST and _AFTER.get(i) not in skip
        p, r = _JAVA_FAST[i] if quick else (pat, _java_replacement(rep))
        out.append((i, "(?mdU)" + p, r))
    return out


def _guard(c: Column, needs) -> Column:
    if needs == "beyond ASCII":
        return F.octet_length(c) != F.length(c)
    cond = None
    for alternative in needs:
        all_of = None
        for sub in alternative:
            has = F.contains(c, F.lit(sub))
            all_of = has if all_of is None else (all_of & has)
        cond = all_of if cond is None else (cond | all_of)
    return cond


def strip_markup(col, fast: bool = True, skip: tuple[int, ...] = ()) -> Column:
    """Apply the rules in order to a string column (NULL stays NULL).

    Pure column expression (usable anywhere, streaming included); it uses the
    linear rewrites but not the row guards. ``with_stripped_markup`` adds the
    guards as well.
    """
    c = F.col(col) if isinstance(col, str) else col
    for _, pat, rep in java_rules(fast, skip):
        c = F.regexp_replace(c, pat, rep)
    return c


def with_stripped_markup(df, col: str, out: str, fast: bool = True,
                         skip: tuple[int, ...] = ()):
    """Add ``out`` = markup-free ``col``; guarded rules run only where they can match.

    Guarded rules read their input three times (guard, rules, fallback), so
    that input is a materialised column of its own projection instead of a
    nested expression (which would grow the expression tree exponentially).
    A text that lacks what a group of rules needs lacks it before each of them:
    what they leave is made of captured groups, in place.
    """
    cur = "_mk0"
    df = df.withColumn(cur, F.col(col))
    step = 0
    pending = F.col(cur)
    for needs, rules in groupby(java_rules(fast, skip), lambda r: _REQUIRES.get(r[0]) if fast else None):
        if needs:
            step += 1
            nxt = f"_mk{step}"
            df = df.withColumn(nxt, pending).drop(cur)
            cur = nxt
            pending = F.col(cur)
        done = pending
        for _, pat, rep in rules:
            done = F.regexp_replace(done, pat, rep)
        pending = F.when(_guard(pending, needs), done).otherwise(pending) if needs else done
    return df.withColumn(out, pending).drop(cur)


def duckdb_expr(col: str, skip: tuple[int, ...] = (SQUEEZE_RULE,)) -> str:
    """The chain as nested DuckDB ``regexp_replace`` calls (RE2, ``(?m)``, global)."""
    expr = col
    for i, (pat, rep, _) in enumerate(MARKUP_RULES):
        if i in skip:
            continue
        if i == len(MARKUP_RULES) - 1:
            pat = _RE2_NUMBERS
        lit = ("(?m)" + pat).replace("'", "''")
        expr = f"regexp_replace({expr}, '{lit}', '{rep}', 'g')"
    return expr


def python_reference(text: str, skip: tuple[int, ...] = ()) -> str:
    """Plain-Python application of the rules, for tests."""
    for i, (pat, rep, _) in enumerate(MARKUP_RULES):
        if i in skip:
            continue
        text = re.sub(pat, rep, text, flags=re.MULTILINE)
    return text
