"""Text scalar functions as native column expressions.

Everything here is a ``Column -> Column`` function that runs inside the JVM
(whole-stage codegen where Spark supports it), so the same expressions work on
batch and streaming DataFrames. Higher-order functions are only used with
lambdas that touch their own arguments, never an outer array, so no per-element
re-evaluation of an array expression can occur.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns.
# Vectoriser tokens: runs of two or more word characters (letters, digits, underscore).
VECTOR_TOKEN = r"[\p{L}\p{N}_]{2,}"
# Word/number tokens: maximal runs of letters, or of digits.
WORD_NUMBER_TOKEN = r"\p{L}+|\p{N}+"
# Whitespace characters as Python's str.split() sees them, written so that
# both Java regex and RE2 read the class the same way.
PY_WS_CHARS = (r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
PY_WHITESPACE = "[" + PY_WS_CHARS + "]+"
# Anything that is neither a word character nor whitespace.
# The ASCII ranges are word characters too: they come first as they are found without Unicode tables.
SYMBOLS = r"(?U)[^a-zA-Z0-9_\x20\w" + PY_WS_CHARS + "]+"
ALNUM = r"^[\p{L}\p{N}]+$"
# PY_WHITESPACE for Java, told from printable ASCII by one comparison.
_WS = "[[^!-~]&&[" + PY_WS_CHARS + "]]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lower(col) -> Column:
    return F.lower(_c(col))


def strip_symbols(col) -> Column:
    """Delete every run of characters that is neither word nor whitespace."""
    return F.regexp_replace(_c(col), SYMBOLS, "")


def vector_terms(col, lowercase: bool = True) -> Column:
    """Tokens of >= 2 word characters, lowercased: array<string>."""
    c = F.lower(_c(col)) if lowercase else _c(col)
    return F.regexp_extract_all(c, F.lit(VECTOR_TOKEN), 0)


def word_number_tokens(col, lowercase: bool = True) -> Column:
    """Tokens that are runs of letters or runs of digits."""
    c = F.lower(_c(col)) if lowercase else _c(col)
    return F.regexp_extract_all(c, F.lit(WORD_NUMBER_TOKEN), 0)


def split_words(col) -> Column:
    """Whitespace split with empty pieces dropped (Python ``str.split()``).

    Other whitespace becomes spaces first: a split at one plain character needs no pattern, one at a
    class of characters takes four times as long.
    """
    spaced = F.regexp_replace(_c(col), f"[[^ -~]&&{_WS}]", " ")
    return F.filter(F.split(spaced, " "), lambda x: x != F.lit(""))


def word_count(col) -> Column:
    """``len(text.split())`` as bigint; NULL text gives 0."""
    return F.coalesce(F.size(split_words(col)).cast("bigint"), F.lit(0).cast("bigint"))


def char_count(col) -> Column:
    """``len(text)`` in code points as bigint; NULL text gives 0."""
    return F.coalesce(F.length(_c(col)).cast("bigint"), F.lit(0).cast("bigint"))


def keep_alnum(tokens) -> Column:
    """Keep tokens made only of letters and digits (``str.isalnum``)."""
    return F.filter(_c(tokens), lambda t: t.rlike(ALNUM))


def squeeze_spaces(col) -> Column:
    """Single spaces between the words of a text whose only whitespace is the space, none at its ends."""
    c = _c(col)
    return F.trim(F.regexp_replace(c, "  +", " "))


def joined_count(col) -> Column:
    """``word_count`` of words joined by single spaces; NULL text gives 0."""
    c = _c(col)
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.coalesce(F.when(c == "", 0).otherwise(spaces + 1).cast("bigint"), F.lit(0).cast("bigint"))


def trim_edge_punct(tokens) -> Column:
    """Strip leading/trailing non-alphanumerics from each token."""
    return F.transform(_c(tokens), lambda t: F.regexp_replace(
        t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def remove_words(tokens, words) -> Column:
    """Drop tokens found in ``words`` (order and duplicates kept; unlike array_except).

    ``isin`` over the literal list becomes a hash-set lookup (``InSet``) per
    token; ``array_contains`` on a literal array would scan the list for every
    token (5x slower on the test corpus with the 181 English stopwords).
    """
    stop = sorted(set(words))
    return F.filter(_c(tokens), lambda t: ~t.isin(*stop))


def join_tokens(tokens, sep: str = " ") -> Column:
    return F.array_join(_c(tokens), sep)


def char_ngrams(col, n: int = 3) -> Column:
    """All character n-grams of the whole string, in order (empty when shorter).

    One regex pass: a zero-width lookahead at every position captures the n
    code points that start there, so the cost is linear in the text length and
    stays in the JVM (no per-character array or lambda functions).
    """
    grams = F.regexp_extract_all(_c(col), F.lit(f"(?s)(?=(.{{{int(n)}}}))"), 1)
    return F.coalesce(grams, F.array().cast("array<string>"))


def term_counts(df, tokens_col: str, keys: list[str]):
    """(keys..., term, df, tf): per key, the rows containing each term (df) and
    its occurrences (tf).

    Each row emits its tokens followed by its distinct tokens
    (``array_distinct``, hash based); ``posexplode`` tells the two parts apart
    by position. One generator and one map-side-combined aggregation, all in
    generated code: no per-row sort and no lambda functions. The ``_outer``
    generator plus a null filter: a plain one makes the optimizer infer a
    ``size(array) > 0`` filter and push it below the projection, which would
    evaluate the token expression again in the scan.
    """
    step = df.select(*keys, F.col(tokens_col).alias("_t"))
    step = step.select(*keys, F.size("_t").alias("_n"),
                       F.concat(F.col("_t"), F.array_distinct("_t")).alias("_a"))
    rows = (step.select(*keys, "_n", F.posexplode_outer("_a").alias("_p", "term"))
                .where(F.col("term").isNotNull()))
    occ = F.col("_p") < F.col("_n")
    return rows.groupBy(*keys, "term").agg(
        F.sum(F.when(occ, 0).otherwise(1)).cast("bigint").alias("df"),
        F.sum(F.when(occ, 1).otherwise(0)).cast("bigint").alias("tf"))


def _run_starts(s: Column) -> Column:
    """Boolean per position of a sorted array: does a new run start here?"""
    n = F.size(s)
    prev = F.slice(F.concat(F.array(F.lit(None).cast("string")), s), 1, n)
    return F.zip_with(s, prev, lambda x, p: p.isNull() | (x != p))


def _bag_from(s: Column, is_start: Column) -> Column:
    n = F.size(s)
    positions = F.sequence(F.lit(0), n - 1)
    starts = F.filter(F.zip_with(is_start, positions,
                                 lambda f, i: F.when(f, i).otherwise(F.lit(-1))),
                      lambda i: i >= 0)
    terms = F.filter(F.zip_with(s, is_start, lambda x, f: F.when(f, x)),
                     lambda x: x.isNotNull())
    ends = F.concat(F.slice(starts, 2, n), F.array(n))
    tf = F.zip_with(starts, ends, lambda a, b: (b - a).cast("bigint"))
    bag = F.zip_with(terms, tf, lambda t, c: F.struct(t.alias("term"), c.alias("tf")))
    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(n > 0, bag).otherwise(empty)


def with_bag(df, tokens_col: str, out_col: str = "bag", keep: list[str] | None = None):
    """Project ``keep`` columns plus the doc-local bag of ``tokens_col``.

    Three projections (sort, run starts, bag): each intermediate array is
    referenced several times downstream, so Catalyst keeps them as separate
    columns instead of inlining and recomputing them.
    """
    keep = list(keep if keep is not None else [c for c in df.columns if c != tokens_col])
    step1 = df.select(*keep, F.sort_array(F.col(tokens_col), asc=True).alias("_s"))
    step2 = step1.select(*keep, "_s", _run_starts(F.col("_s")).alias("_starts"))
    return step2.select(*keep, _bag_from(F.col("_s"), F.col("_starts")).alias(out_col))


def explode_bag(df, bag_col: str = "bag", keep: list[str] | None = None):
    """One row per (row, term) with ``term``/``tf`` columns.

    ``inline_outer`` + a null filter instead of ``inline``: the optimizer infers a
    ``size(bag) > 0`` filter for ``inline`` and pushes it below the projection,
    which would evaluate the whole bag expression again.
    """
    keep = list(keep if keep is not None else [c for c in df.columns if c != bag_col])
    return (df.select(*keep, F.inline_outer(F.col(bag_col)))
              .where(F.col("term").isNotNull()))


def explode_terms(arr, name: str = "term") -> tuple[Column, Column]:
    """(generator, filter) pair: explode ``arr`` without letting the optimizer
    re-evaluate it in a pushed-down ``size > 0`` filter (see ``term_counts``)."""
    return F.explode_outer(arr).alias(name), F.col(name).isNotNull()
