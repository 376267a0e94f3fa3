"""Lemmatising (X10) and spelling correction (X11) as distributed joins.

Both work on the *distinct* tokens of a corpus, build a small (form -> output)
table, and map it back onto the token arrays:

* lemmas: an exception table first; otherwise noun suffix rules whose result is
  a known word; among the valid candidates (the form itself included when it
  is known) the shortest wins, ties by rule order. Known words default to the
  corpus's own tokens.
* spelling: dictionary words within Levenshtein distance ``max_dist`` of an unknown token. Words up to
  SHORT letters are found by deletions: two words that near give the same letters when at most as many
  are deleted from each, so they meet on the hashes of all that deletions leave. Longer words are
  found by segments: one cut into ``max_dist + 1`` parts keeps at least one of them, within ``max_dist``
  places, in everything that near to it, and such parts are long enough to be rare. Levenshtein
  filters what meets. Every word counts, the shortest included. The nearest distance class wins, and its most frequent word is kept when
  its share of that class's frequency reaches ``min_share``; so distances are searched one after
  another, each only for the unknown tokens that have found nothing nearer (short tokens,
  which are near to very many words, nearly all find one at distance 1).

Mapping back: a table that measures small is looked up where the tokens stand, in Arrow batches,
and nothing is shuffled. A larger one is joined to the distinct tokens of each document, salted,
and comes back to it as a map of the document's own tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import fits_broadcast, salted_join

#: A table of forms up to this size is sent to the workers.
TABLE_MAX_BYTES = 64 << 20
#: A token is hot from this part of all occurrences.
HOT = 1024

# Noun suffix rules (suffix, replacement), in order.
NOUN_RULES = (("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
              ("shes", "sh"), ("men", "man"), ("ies", "y"))

# Default irregular forms (form, lemma).
IRREGULAR = (("children", "child"), ("feet", "foot"), ("geese", "goose"), ("men", "man"),
             ("mice", "mouse"), ("people", "person"), ("teeth", "tooth"), ("women", "woman"))


def distinct_tokens(df: DataFrame, tokens_col: str) -> DataFrame:
    """(token, freq) over the whole corpus (one map-side-combined aggregation)."""
    return (df.select(F.explode_outer(F.col(tokens_col)).alias("token"))
              .where(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))


def hot_tokens(tokens: DataFrame) -> list[str]:
    """The tokens of (token, freq) that have a 1/HOT of all occurrences: so HOT at most."""
    total = tokens.agg(F.sum("freq")).first()[0] or 0
    return [r["token"] for r in tokens.where(F.col("freq") * HOT >= total).select("token").collect()]


def lemma_table(tokens: DataFrame, known: DataFrame, exceptions: DataFrame | None = None,
                rules=NOUN_RULES) -> DataFrame:
    """(token, lemma) for tokens whose lemma differs from the token.

    ``tokens``: distinct ``token`` column; ``known``: ``word`` column.
    """
    # A token that no rule applies to can only be its own lemma: it goes no further.
    own = F.struct(F.col("token").alias("cand"), F.lit(0).alias("rule"))
    cands = [F.when(F.col("token").endswith(suf) & (F.length("token") > len(suf)), F.struct(
        F.concat(F.expr(f"substring(token, 1, length(token) - {len(suf)})"), F.lit(rep)).alias("cand"),
        F.lit(i + 1).alias("rule"))) for i, (suf, rep) in enumerate(rules)]
    some = F.col("token").rlike("(?:" + "|".join(re.escape(suf) for suf, _ in rules) + r")\z")
    allc = (tokens.where(some).select("token", F.explode(F.array(own, *cands)).alias("c"))
                  .where(F.col("c").isNotNull()).select("token", "c.cand", "c.rule"))
    valid = allc.join(known.select(F.col("word").alias("cand")), "cand", "left_semi")
    best = (valid.groupBy("token")
                 .agg(F.min(F.struct(F.length("cand").alias("len"), F.col("rule"), F.col("cand")))
                      .alias("b"))
                 .select("token", F.col("b.cand").alias("lemma")))
    if exceptions is not None:
        exc = exceptions.select(F.col("form").alias("token"), F.col("lemma").alias("exc"))
        best = (best.join(exc.join(tokens.select("token"), "token"), "token", "full_outer")
                    .select("token", F.coalesce("exc", "lemma").alias("lemma"))
                      .where(F.col("lemma").isNotNull()))
    return best.where(F.col("lemma") != F.col("token"))


def map_tokens(df: DataFrame, id_col: str, tokens_col: str, table: DataFrame, out: str,
               drop_missing: bool = False, max_bytes: int = TABLE_MAX_BYTES,
               hot: list[str] | None = None) -> DataFrame:
    """Replace each token through ``table(token, lemma)``; order kept. NULL tokens go.

    ``drop_missing``: tokens without a table row are dropped instead of kept; ``hot``: the frequent tokens, if they
    are known (``hot_tokens``).
    """
    if fits_broadcast(table.select("token", "lemma"), max_bytes):
        return _map_in_place(df, tokens_col, table, out, drop_missing)
    # Documents keep their rows: an id may repeat. 64 bits would meet by chance among 10^10 documents.
    of = (F.col(id_col).cast("string"), F.col(tokens_col))
    rows = df.withColumn("_row", F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit(1), *of).alias("b")))
    words = rows.select("_row", F.explode_outer(F.array_distinct(tokens_col)).alias("token")).where(
        "token IS NOT NULL")
    found = salted_join(words, table.select("token", "lemma"), ["token"], salt_from=["_row", "token"], hot=hot)
    pairs = found.groupBy("_row").agg(F.collect_set(F.struct("token", "lemma")).alias("_pairs"))  # rows may be equal

    @F.arrow_udf("array<string>")
    def look_up(tokens: pa.Array, forms: pa.Array, lemmas: pa.Array) -> pa.Array:
        none, own = pa.array([], pa.string()), []
        for row in zip(tokens, forms, lemmas):
            flat, known, to = (none if x.values is None else x.values for x in row)
            found = to.take(pc.index_in(flat, value_set=known))
            own.append((found if drop_missing else pc.coalesce(found, flat)).drop_null())
        ends = np.cumsum([0, *map(len, own)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([none, *own]))

    # Hashed in Arrow: a lookup in a map of Spark's reads it from its start.
    return rows.join(pairs.hint("merge"), "_row", "left").withColumn(
        out, look_up(F.col(tokens_col), F.col("_pairs.token"), F.col("_pairs.lemma"))).drop("_row", "_pairs")


def _map_in_place(df: DataFrame, tokens_col: str, table: DataFrame, out: str,
                  drop_missing: bool) -> DataFrame:
    """The lookup by a table whose size was measured, sent to the workers once, as Arrow columns: neither
    the driver nor a worker makes a Python object of a token."""
    pairs = table.where("token IS NOT NULL").select("token", "lemma").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pairs.schema) as to:
        to.write_table(pairs)
    shipped = df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    @F.arrow_udf("array<string>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.ipc.open_stream(shipped.value).read_all().combine_chunks()
        forms, lemmas = (pa.concat_arrays(known[c].chunks or [pa.array([], pa.string())]) for c in known.column_names)
        for tokens in batches:
            flat = tokens.flatten()  # of null arrays: nothing
            found = lemmas.take(pc.index_in(flat, value_set=forms))
            if not drop_missing:
                found = pc.coalesce(found, flat)
            kept = found.is_valid()
            size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(tokens)), size)[kept.to_numpy(zero_copy_only=False)]
            ends = np.cumsum(np.bincount(row, minlength=len(tokens)))
            yield pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), found.filter(kept))

    return df.withColumn(out, look_up(F.col(tokens_col)))


def _parts(length, parts: int) -> list[tuple]:
    """(start, size) columns, start from 1, of the parts that a word of ``length`` is cut into."""
    small, more = F.floor(length / parts).cast("int"), length % parts
    out, start = [], F.lit(1)
    for i in range(parts):
        # The last ``more`` parts are one longer.
        size = small + F.when(parts - more <= i, 1).otherwise(0)
        out.append((start, size))
        start = start + size
    return out


#: Letters of the longest words that are found by deletions; longer ones are found by segments.
SHORT = 12


def _deletions(col: str, n: int):
    """Hashes of what is left of a word after up to ``n`` deletions, distinct."""
    left = [F.array(F.col(col))]
    for _ in range(n):
        left.append(F.array_distinct(F.flatten(F.transform(left[-1], lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
            lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))))))
    return F.array_distinct(F.transform(F.flatten(F.array(*left)), lambda w: F.xxhash64(w)))


def near_words(tokens: DataFrame, dictionary: DataFrame, max_dist: int = 2) -> DataFrame:
    """(token, word, freq, dist): all dictionary words within ``max_dist`` of each token."""
    short = tokens.where(F.length("token") <= SHORT + max_dist).select(
        "token", F.explode(_deletions("token", max_dist)).alias("key")).join(
        dictionary.where(F.length("word") <= SHORT).select(
            "word", "freq", F.explode(_deletions("word", max_dist)).alias("key")).hint("merge"), "key")
    longer = _by_segments(tokens.where(F.length("token") > SHORT - max_dist),
                          dictionary.where(F.length("word") > SHORT), max_dist)
    pairs = short.select("token", "word", "freq").unionByName(longer).distinct()
    return pairs.withColumn("dist", F.levenshtein("token", "word", max_dist)).where(F.col("dist") >= 0)


def _by_segments(tokens: DataFrame, dictionary: DataFrame, max_dist: int) -> DataFrame:
    """(token, word, freq) that may be near: one part of the word stands in the token."""
    n = max_dist + 1
    word_len = F.length("word")
    keys = F.array(*[F.struct(word_len.alias("len"), F.lit(i).alias("part"),
                              F.substring(F.col("word"), a, size).alias("piece"))
                     for i, (a, size) in enumerate(_parts(word_len, n))])
    dk = dictionary.select("word", "freq", F.inline(keys))
    # A part that is kept at a shift costs at least |shift| edits before it and |shift + d| behind it.
    places = [(d, i, shift) for d in range(-max_dist, max_dist + 1) for i in range(n)
              for shift in range(-((max_dist + d) // 2), (max_dist - d) // 2 + 1)]
    place = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("part"), F.lit(x).alias("shift"))
                                for d, i, x in places]))
    tk = tokens.select("token", place.alias("p")).select(
        "token", "p.part", "p.shift", (F.length("token") + F.col("p.d")).alias("len")).where("len >= 0")
    small, more = F.floor(F.col("len") / n), F.col("len") % n
    size = small + (F.col("part") >= n - more).cast("int")  # the last ``more`` parts are one longer
    at = small * F.col("part") + F.greatest(F.col("part") - (n - more), F.lit(0)) + 1 + F.col("shift")
    tk = tk.select("token", "len", "part", at.cast("int").alias("at"), size.cast("int").alias("size")).where(
        "at >= 1 AND at + size - 1 <= length(token)").select(
        "token", "len", "part", F.expr("substring(token, at, size)").alias("piece")).distinct()
    return tk.join(dk.hint("merge"), ["len", "part", "piece"]).select("token", "word", "freq")


def correction_table(tokens: DataFrame, dictionary: DataFrame, max_dist: int = 2,
                     min_share: float = 0.85) -> DataFrame:
    """(token, lemma) for unknown tokens with a confident correction.

    ``tokens``: distinct ``token``; ``dictionary``: (word, freq). Known tokens
    are not in the result (callers keep them unchanged).
    """
    dict_words = dictionary.select("word", "freq")
    # Both sides grow with the corpus: merged, a side is never gathered on the driver to be broadcast.
    unknown = tokens.select("token").join(dict_words.select(F.col("word").alias("token")).hint("merge"),
                                          "token", "left_anti")
    found = []
    for dist in range(1, max_dist + 1):
        unknown = materialize(unknown)
        near = near_words(unknown, dict_words, dist).where(F.col("dist") == dist)
        found.append(materialize(near.groupBy("token").agg(F.sum("freq").alias("total"),
                                                           F.max(F.struct("freq", "word")).alias("best"))))
        unknown = unknown.join(found[-1].hint("merge"), "token", "left_anti")
    near = reduce(DataFrame.unionByName, found)
    return near.where(F.col("best.freq") / F.col("total") >= min_share).select(
        "token", F.col("best.word").alias("lemma"))
