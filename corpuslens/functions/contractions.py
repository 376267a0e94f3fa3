"""Contraction expansion (X3) over a lowercase text column.

The text is cut, in one pass, into words with an apostrophe inside, other words, and what
stands between; the first kind is looked up in the mapping (straight and curly apostrophes
alike). The mapping is a parameter; the default covers common English contractions. Rows
without an apostrophe are left as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default contraction -> expansion mapping (lowercase).
CONTRACTIONS: dict[str, str] = {
    "ain't": "are not", "aren't": "are not", "can't": "cannot", "couldn't": "could not",
    "didn't": "did not", "doesn't": "does not", "don't": "do not", "hadn't": "had not",
    "hasn't": "has not", "haven't": "have not", "he'd": "he would", "he'll": "he will",
    "he's": "he is", "i'd": "i would", "i'll": "i will", "i'm": "i am", "i've": "i have",
    "isn't": "is not", "it'd": "it would", "it'll": "it will", "it's": "it is",
    "let's": "let us", "mightn't": "might not", "mustn't": "must not", "shan't": "shall not",
    "she'd": "she would", "she'll": "she will", "she's": "she is", "shouldn't": "should not",
    "that's": "that is", "there's": "there is", "they'd": "they would", "they'll": "they will",
    "they're": "they are", "they've": "they have", "wasn't": "was not", "we'd": "we would",
    "we'll": "we will", "we're": "we are", "we've": "we have", "weren't": "were not",
    "what's": "what is", "where's": "where is", "who's": "who is", "won't": "will not",
    "wouldn't": "would not", "you'd": "you would", "you'll": "you will", "you're": "you are",
    "you've": "you have", "y'all": "you all",
}

APOSTROPHES = ("'", "’")


# Words with an apostrophe inside, other words, and what stands between them.
_PIECES = r"[\p{L}\p{N}_]+['’][\p{L}\p{N}_]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def duckdb_expr(col: str, mapping: dict[str, str] = CONTRACTIONS) -> str:
    """The same in DuckDB SQL."""
    def q(x):
        return "'" + x.replace("'", "''") + "'"

    cases = " ".join(f"WHEN {q(form)} THEN {q(full)}" for form, full in sorted(mapping.items()))
    straight = f"replace(x, {q('’')}, {q(APOSTROPHES[0])})"
    return (f"array_to_string(list_transform(regexp_extract_all({col}, {q(_PIECES)}), "
            f"lambda x: CASE {straight} {cases} ELSE x END), '')")


def with_expanded_contractions(df: DataFrame, col: str, out: str,
                               mapping: dict[str, str] = CONTRACTIONS) -> DataFrame:
    """Add ``out``: ``col`` with contractions replaced (apostrophe-free rows untouched)."""
    src = F.col(col)
    table = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])

    def expand(t):
        inside = (F.instr(t, "'") > 1) | (F.instr(t, "’") > 1)
        return F.when(inside, F.coalesce(table[F.translate(t, "’", "'")], t)).otherwise(t)

    expanded = F.array_join(F.transform(F.regexp_extract_all(src, F.lit(_PIECES), 0), expand), "")
    has = None
    for a in APOSTROPHES:
        h = F.contains(src, F.lit(a))
        has = h if has is None else (has | h)
    return df.withColumn(out, F.when(has, expanded).otherwise(src))
