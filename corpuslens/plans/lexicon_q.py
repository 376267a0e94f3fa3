"""Lemmatising (X10, X18) and spelling correction (X11) over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.markup import SQUEEZE_RULE
from ..functions.text import join_tokens, word_number_tokens
from ..operators import clean
from ..operators import lemmas as L
from ..session import materialize
from ..sources.io import read_table
from . import clean_q
from .registry import query

# Dictionary threshold for spelling correction.
MIN_DICT_FREQ = 5
MAX_DIST = 2
MIN_SHARE = 0.85
#: A table of all known words up to this size goes through the driver to the workers; it grows with the corpus.
DICT_MAX_BYTES = 1 << 20


def _tokens(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True)
    return docs.select("doc_id", word_number_tokens("text").alias("tokens"))


def _lemma_sql() -> str:
    rules = ", ".join(f"({i + 1}, '{s}', '{r}')" for i, (s, r) in enumerate(L.NOUN_RULES))
    exc = ", ".join(f"('{f}', '{m}')" for f, m in L.IRREGULAR)
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+|\\p{{N}}+') AS toks
              FROM documents),
pos AS (SELECT doc_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos FROM docs),
d AS (SELECT DISTINCT token FROM pos),
rules(rule, suf, rep) AS (VALUES {rules}),
exc(form, lemma) AS (VALUES {exc}),
cand AS (SELECT token, token AS cand, 0 AS rule FROM d
         UNION ALL
         SELECT token, substr(token, 1, length(token) - length(suf)) || rep AS cand, rule
         FROM d JOIN rules ON suffix(token, suf) AND length(token) > length(suf)),
valid AS (SELECT * FROM cand WHERE cand IN (SELECT token FROM d)),
best AS (SELECT token, arg_min(cand, length(cand) * 1000 + rule) AS lemma FROM valid GROUP BY token),
lt AS (SELECT d.token, coalesce(exc.lemma, best.lemma) AS lemma
       FROM d LEFT JOIN exc ON exc.form = d.token LEFT JOIN best ON best.token = d.token),
out AS (SELECT pos.doc_id, string_agg(coalesce(lt.lemma, pos.token), ' ' ORDER BY pos.pos) AS lemmas
        FROM pos LEFT JOIN lt ON lt.token = pos.token GROUP BY pos.doc_id)
SELECT docs.doc_id, coalesce(out.lemmas, '') AS lemmas FROM docs LEFT JOIN out USING (doc_id)"""


@query("lemmatise", sql=_lemma_sql())
def lemmatise(spark, sf_dir):
    """Word/number tokens mapped to lemmas (irregular table, then suffix rules checked
    against the corpus's own words), re-joined in order."""
    toks = _tokens(spark, sf_dir)
    out = L.map_tokens(toks, "doc_id", "tokens", lemmas_of(spark, toks), "lemma_tokens")
    return out.select("doc_id", join_tokens("lemma_tokens").alias("lemmas"))


# DuckDB's levenshtein counts bytes: letters beyond ASCII become capitals (the tokens have none).
_WIDE = "äöüßéèêçàâîôûùëïœóíñáúìòõã"


def _narrow(col: str) -> str:
    return f"translate({col}, '{_WIDE}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


_SPELL_SQL = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+|\\p{{N}}+') AS toks FROM documents),
pos AS (SELECT doc_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos FROM docs),
d AS (SELECT token, count(*) AS freq FROM pos GROUP BY token),
dic AS (SELECT token AS word, freq FROM d WHERE freq >= {MIN_DICT_FREQ}),
unk AS (SELECT token FROM d WHERE freq < {MIN_DICT_FREQ}),
-- Words within {MAX_DIST} edits give the same letters when up to {MAX_DIST} are deleted from each: an
-- exact filter for words up to 14 letters; the few longer ones meet by length.
cut AS (
  SELECT w, unnest(list_distinct(list_concat([w], list_concat(one, flatten([
           [substr(x, 1, i - 1) || substr(x, i + 1) for i in range(1, length(x) + 1)] for x in one]))))) AS left_over
  FROM (SELECT w, [substr(w, 1, i - 1) || substr(w, i + 1) for i in range(1, length(w) + 1)] AS one
        FROM (SELECT token AS w FROM d WHERE length(token) <= 14))),
may AS (
  SELECT DISTINCT token, word, freq FROM unk JOIN cut a ON a.w = token JOIN cut b USING (left_over)
  JOIN dic ON word = b.w
  UNION
  SELECT token, word, freq FROM unk JOIN dic ON abs(length(token) - length(word)) <= {MAX_DIST}
   AND (length(token) > 14 OR length(word) > 14)),
near AS (SELECT token, word, freq, levenshtein({_narrow('token')}, {_narrow('word')}) AS dist FROM may
         WHERE levenshtein({_narrow('token')}, {_narrow('word')}) <= {MAX_DIST}),
cls AS (SELECT token, dist, sum(freq) AS total, max(freq) AS most FROM near GROUP BY token, dist),
c AS (SELECT * FROM cls WHERE (token, dist) IN (SELECT token, min(dist) FROM cls GROUP BY token)),
best AS (SELECT c.token, max(near.word) AS lemma FROM c JOIN near ON near.token = c.token
         AND near.dist = c.dist AND near.freq = c.most WHERE c.most / c.total >= {MIN_SHARE} GROUP BY c.token),
lt AS (SELECT word AS token, word AS lemma FROM dic UNION ALL SELECT token, lemma FROM best),
out AS (SELECT pos.doc_id, string_agg(lt.lemma, ' ' ORDER BY pos.pos) AS corrected, count(*) AS n
        FROM pos JOIN lt ON lt.token = pos.token GROUP BY pos.doc_id)
SELECT docs.doc_id, coalesce(out.corrected, '') AS corrected, CAST(coalesce(out.n, 0) AS BIGINT) AS n_tokens
FROM docs LEFT JOIN out USING (doc_id)"""


@query("spell_correct", sql=_SPELL_SQL)
def spell_correct(spark, sf_dir):
    """Tokens kept when known, replaced when an unknown token has a confident
    correction, dropped otherwise. Dictionary: corpus words seen >= 5 times."""
    toks = _tokens(spark, sf_dir)
    d = materialize(L.distinct_tokens(toks, "tokens"))
    dictionary = d.where(F.col("freq") >= MIN_DICT_FREQ).select(F.col("token").alias("word"), "freq")
    fixes = L.correction_table(d, dictionary, MAX_DIST, MIN_SHARE)
    keep = dictionary.select(F.col("word").alias("token"), F.col("word").alias("lemma"))
    table = materialize(keep.unionByName(fixes))
    out = L.map_tokens(toks, "doc_id", "tokens", table, "fixed", drop_missing=True, max_bytes=DICT_MAX_BYTES,
                       hot=L.hot_tokens(d))
    return out.select("doc_id", join_tokens("fixed").alias("corrected"),
                      F.size("fixed").cast("bigint").alias("n_tokens"))


def lemmas_of(spark, tokens):
    """The lemma table of a column ``tokens``, known words being the corpus's own."""
    d = materialize(L.distinct_tokens(tokens, "tokens"))
    exc = spark.createDataFrame(list(L.IRREGULAR), "form string, lemma string")
    return materialize(L.lemma_table(d, d.select(F.col("token").alias("word")), exc))


def _clean_lemma_sql(inner: str) -> str:
    """A cleaner's SQL, its words mapped to lemmas by the table of the cleaned corpus itself."""
    rules = ", ".join(f"({i + 1}, '{s}', '{r}')" for i, (s, r) in enumerate(L.NOUN_RULES))
    exc = ", ".join(f"('{f}', '{m}')" for f, m in L.IRREGULAR)
    return f"""
WITH cl AS ({inner}),
docs AS (SELECT doc_id, list_filter(string_split(clean_post, ' '), lambda x: x <> '') AS toks FROM cl),
pos AS (SELECT doc_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos FROM docs),
d AS (SELECT DISTINCT token FROM pos),
rules(rule, suf, rep) AS (VALUES {rules}),
exc(form, lemma) AS (VALUES {exc}),
cand AS (SELECT token, token AS cand, 0 AS rule FROM d
         UNION ALL
         SELECT token, substr(token, 1, length(token) - length(suf)) || rep AS cand, rule
         FROM d JOIN rules ON suffix(token, suf) AND length(token) > length(suf)),
valid AS (SELECT * FROM cand WHERE cand IN (SELECT token FROM d)),
best AS (SELECT token, arg_min(cand, length(cand) * 1000 + rule) AS lemma FROM valid GROUP BY token),
lt AS (SELECT d.token, coalesce(exc.lemma, best.lemma) AS lemma
       FROM d LEFT JOIN exc ON exc.form = d.token LEFT JOIN best ON best.token = d.token),
out AS (SELECT pos.doc_id, string_agg(coalesce(lt.lemma, pos.token), ' ' ORDER BY pos.pos) AS lemmas
        FROM pos LEFT JOIN lt ON lt.token = pos.token GROUP BY pos.doc_id)
SELECT docs.doc_id, coalesce(out.lemmas, '') AS clean_post,
       CAST(len(docs.toks) AS BIGINT) AS nr_of_words,
       CAST(length(coalesce(out.lemmas, '')) AS BIGINT) AS nr_of_characters
FROM docs LEFT JOIN out USING (doc_id)"""


def _cleaned_with_lemmas(spark, sf_dir, how, **kw):
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    # Cleaned once: the words are counted before they are mapped. Texts take less room than their words.
    texts = materialize(clean.clean_table(docs, "text", how, **kw).select("doc_id", "clean_post"))
    cleaned = texts.select("doc_id", F.filter(F.split("clean_post", " "), lambda x: x != F.lit("")).alias("tokens"))
    table = lemmas_of(spark, cleaned)
    return clean.with_lemmas(cleaned, "tokens", table).select(
        "doc_id", "clean_post", "nr_of_words", "nr_of_characters")


@query("clean_text_lemmas", sql=_clean_lemma_sql(clean_q.full_sql()))
def clean_text_lemmas(spark, sf_dir):
    """The full cleaner (X16) with lemmas; without the run squeeze, so RE2 can check it."""
    return _cleaned_with_lemmas(spark, sf_dir, "full", skip_rules=(SQUEEZE_RULE,))


@query("normalise_lemmas", sql=_clean_lemma_sql(clean_q.basic_sql()))
def normalise_lemmas(spark, sf_dir):
    """The short cleaner (X17) with lemmas."""
    return _cleaned_with_lemmas(spark, sf_dir, "basic")
