"""Cleaning queries (X1-X18) over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contractions as C
from ..functions import markup as M
from ..functions import text as T
from ..operators import clean
from ..sources.io import read_table
from ..sources.stopwords import stopwords
from .registry import query

WS = T.PY_WHITESPACE


def _stop_list_sql() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stopwords("english")) + "]"


def _texts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True).select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text"))
    pages = read_table(spark, sf_dir, "pages", spread=True).select(
        F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages)


_TEXTS_SQL = ("(SELECT 'documents' AS source, doc_id AS id, text FROM documents "
              "UNION ALL SELECT 'pages' AS source, page_id AS id, html AS text FROM pages)")


@query("strip_markup", sql=f"""
SELECT source, id, {M.duckdb_expr('text')} AS clean FROM {_TEXTS_SQL} x""")
def strip_markup(spark, sf_dir):
    """All markup rules except the run squeeze (RE2 has no backreferences)."""
    out = M.with_stripped_markup(_texts(spark, sf_dir), "text", "clean", skip=(M.SQUEEZE_RULE,))
    return out.select("source", "id", "clean")


@query("strip_markup_full")
def strip_markup_full(spark, sf_dir):
    """All 28 rules; checked against Python ``re`` in the tests."""
    out = M.with_stripped_markup(_texts(spark, sf_dir), "text", "clean")
    return out.select("source", "id", "clean")


def basic_sql() -> str:
    return f"""
WITH t AS (
  SELECT doc_id, array_to_string(list_filter(list_transform(
           string_split_regex(lower(text), '{WS}'),
           lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')),
         lambda x: regexp_full_match(x, '[\\p{{L}}\\p{{N}}]+') AND NOT list_contains({_stop_list_sql()}, x)),
         ' ') AS clean_post
  FROM documents)
SELECT doc_id, clean_post,
       CAST(len(list_filter(string_split_regex(clean_post, '{WS}'), lambda x: x <> '')) AS BIGINT)
         AS nr_of_words,
       CAST(length(clean_post) AS BIGINT) AS nr_of_characters
FROM t"""


@query("normalise_basic", sql=basic_sql())
def normalise_basic(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    return clean.clean_table(docs, "text", "basic").select(
        "doc_id", "clean_post", "nr_of_words", "nr_of_characters")


def full_sql() -> str:
    return f"""
WITH m AS (SELECT doc_id, lower({M.duckdb_expr('text')}) AS t FROM documents),
c AS (SELECT doc_id, {C.duckdb_expr('t')} AS t FROM m),
s AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(t, '{WS}'),
        lambda x: x <> '' AND NOT list_contains({_stop_list_sql()}, x)), ' ') AS t FROM c),
y AS (SELECT doc_id, regexp_replace(t, '[^\\w{T.PY_WS_CHARS}]+', '', 'g') AS t FROM s),
z AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(t, '{WS}'),
        lambda x: x <> ''), ' ') AS clean_post FROM y)
SELECT doc_id, clean_post,
       CAST(len(list_filter(string_split_regex(clean_post, '{WS}'), lambda x: x <> '')) AS BIGINT)
         AS nr_of_words,
       CAST(length(clean_post) AS BIGINT) AS nr_of_characters
FROM z"""


@query("clean_text", sql=full_sql())
def clean_text(spark, sf_dir):
    """The full cleaner without the run squeeze, so RE2 can check it."""
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    return clean.clean_table(docs, "text", "full", skip_rules=(M.SQUEEZE_RULE,)).select(
        "doc_id", "clean_post", "nr_of_words", "nr_of_characters")


@query("clean_text_full")
def clean_text_full(spark, sf_dir):
    """The full cleaner with every rule (checked against Python in the tests)."""
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    return clean.clean_table(docs, "text", "full").select(
        "doc_id", "clean_post", "nr_of_words", "nr_of_characters")


@query("expand_contractions", sql=f"""
SELECT doc_id, {C.duckdb_expr('lower(text)')} AS expanded FROM documents""")
def expand_contractions(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True).select(
        "doc_id", F.lower("text").alias("lt"))
    return C.with_expanded_contractions(docs, "lt", "expanded").select("doc_id", "expanded")


# Words of the test texts that are written as contractions, so that there are some.
_SHORTENED = ((" it ", " it's "), (" an ", " can’t "), (" un ", " don't "), (" es ", " y'all've "),
              (" la ", " l'homme "), (" die ", " we'll "))


def _shortened_sql() -> str:
    expr = "lower(text)"
    for word, short in _SHORTENED:
        expr = f"replace({expr}, '{word}', '{short.replace(chr(39), chr(39) * 2)}')"
    return expr


@query("expand_contractions_made", sql=f"""
SELECT doc_id, {C.duckdb_expr(_shortened_sql())} AS expanded FROM documents""")
def expand_contractions_made(spark, sf_dir):
    """Contractions on the documents with some words of theirs written as contractions."""
    text = F.lower("text")
    for word, short in _SHORTENED:
        text = F.replace(text, F.lit(word), F.lit(short))
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", text.alias("lt"))
    return C.with_expanded_contractions(docs, "lt", "expanded").select("doc_id", "expanded")


@query("word_number_tokens", sql="""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+'), ' ') AS tokens,
       CAST(len(regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+')) AS BIGINT) AS n_tokens
FROM documents""")
def word_number_tokens(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True)
    toks = T.word_number_tokens("text")
    return docs.select("doc_id", T.join_tokens(toks).alias("tokens"),
                       F.size(toks).cast("bigint").alias("n_tokens"))


@query("user_function_counts", sql=f"""
SELECT doc_id,
       CAST(len(list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '')) AS BIGINT)
         AS nr_of_words,
       CAST(length(text) AS BIGINT) AS nr_of_characters
FROM documents""")
def user_function_counts(spark, sf_dir):
    """X13/X14 on the raw texts through user Python functions: a per-value
    function (``str.split``) and a per-batch one (pandas ``str.len``)."""
    from ..functions.user import map_column, map_partitions

    # Defined here so the workers unpickle it by value, not by importing this module.
    def char_count(pdf):
        return pdf.assign(nr_of_characters=pdf["text"].str.len().astype("Int64")) \
                  .drop(columns="text")

    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    words = map_column(docs, "text", lambda t: len(t.split()), "nr_of_words", "bigint")
    return map_partitions(words, char_count,
                          "doc_id long, nr_of_words long, nr_of_characters long")
