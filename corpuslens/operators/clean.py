"""Text cleaners (X1-X18 compositions) as DataFrame -> DataFrame operators.

* ``full_clean`` (X16): markup rules -> lowercase -> contractions -> stopword
  removal on whitespace tokens -> symbols removed -> whitespace tokens ->
  joined by single spaces.
* ``basic_clean`` (X17): lowercase -> whitespace tokens with edge punctuation
  trimmed (our stand-in for a Treebank tokenizer) -> alphanumeric tokens only ->
  stopwords dropped -> joined.
* ``tokens_only`` (X18): lowercase runs of letters or digits.

All steps are JVM expressions in one or a few projections. Lemmas (``with_lemmas``) follow as a
lookup of the cleaned tokens in a (form, lemma) table (see ``operators.lemmas``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.contractions import CONTRACTIONS, with_expanded_contractions
from ..functions.markup import with_stripped_markup
from ..sources.stopwords import stopwords
from .features import counts
from .lemmas import map_tokens


def full_clean(df: DataFrame, text_col: str, out: str = "clean_post",
               stop: tuple[str, ...] | None = None, contractions: dict | None = None,
               skip_rules: tuple[int, ...] = ()) -> DataFrame:
    stop = stopwords("english") if stop is None else stop
    contractions = CONTRACTIONS if contractions is None else contractions
    d = with_stripped_markup(df, text_col, "_c1", skip=skip_rules)
    d = d.withColumn("_c1", F.lower("_c1"))
    d = with_expanded_contractions(d, "_c1", "_c2", contractions).drop("_c1")
    no_stop = T.join_tokens(T.remove_words(T.split_words("_c2"), stop))
    return d.withColumn(out, T.squeeze_spaces(T.strip_symbols(no_stop))).drop("_c2")


def basic_tokens(text_col, stop: tuple[str, ...] | None = None):
    stop = stopwords("english") if stop is None else stop
    toks = T.trim_edge_punct(T.split_words(F.lower(F.col(text_col))))
    return T.remove_words(T.keep_alnum(toks), stop)


def basic_clean(df: DataFrame, text_col: str, out: str = "clean_post",
                stop: tuple[str, ...] | None = None) -> DataFrame:
    toks = basic_tokens(text_col, stop)
    return df.withColumn(out, T.join_tokens(toks))


def tokens_only(df: DataFrame, text_col: str, out: str = "clean_post") -> DataFrame:
    toks = T.word_number_tokens(text_col)
    return df.withColumn(out, T.join_tokens(toks))


def with_lemmas(df: DataFrame, tokens_col: str, table: DataFrame, id_col: str = "doc_id",
                out: str = "clean_post") -> DataFrame:
    """``out``: the tokens through a lemma table (``lemmas.lemma_table``), joined, and its counts."""
    mapped = map_tokens(df, id_col, tokens_col, table, "_lemmas")
    return counts(mapped.withColumn(out, T.join_tokens("_lemmas")).drop("_lemmas"), out)


def clean_table(df: DataFrame, text_col: str, how: str = "basic", **kw) -> DataFrame:
    """Cleaned text plus word/character counts (the clean table of the data model)."""
    fn = {"basic": basic_clean, "full": full_clean, "tokens": tokens_only}[how]
    out = fn(df, text_col, "clean_post", **kw)
    # Every cleaner joins its words by single spaces.
    return counts(out, "clean_post", joined=True)
