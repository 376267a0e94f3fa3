"""Language identification (L1, L2).

L1 is a character-trigram naive Bayes model learnt from a labelled table:

* profile: c(l, g) = occurrences of trigram g in the texts of language l,
  n(l) = all trigrams of l, V = distinct trigrams over all languages;
* score(d, l) = sum_g k(d, g) * ln((c(l, g) + 1) / (n(l) + V)), k = count of g in d;
* prediction = argmax_l score (ties: language ascending).

Texts are lowercased and used whole. The score splits into
sum_g k * ln(c + 1) over trigrams the language has seen, minus
K(d) * ln(n(l) + V), so only matching (doc, trigram, language) rows are ever
produced: a language with no matching trigram keeps its baseline term alone,
and the best baseline over all languages is one scalar.

L2 applies any user model in batches through an iterator pandas UDF
(``detect_with``); the model is built once per Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, explode_bag, explode_terms, with_bag
from ..session import materialize
from .joins import BROADCAST_MAX_BYTES, salted_join


def trigram_rows(df: DataFrame, text_col: str, keep: list[str], n: int = 3) -> DataFrame:
    """([keep...], term): one row per trigram occurrence of the lowercased text.

    The rows are never shuffled as such: each consumer aggregates them
    map-side in the same stage (profile counts, per-document scores).
    """
    grams = df.select(*keep, char_ngrams(F.lower(F.col(text_col)), n).alias("_g"))
    gen, nonnull = explode_terms(F.col("_g"))
    return grams.select(*keep, gen).where(nonnull)


def fit_profiles(df: DataFrame, id_col: str, text_col: str, lang_col: str, n: int = 3):
    """Return (profile(lang, term, c), priors(lang, n_lang, v)) from labelled texts."""
    base = df.where(F.col(lang_col).isNotNull())
    grams = trigram_rows(base, text_col, [lang_col], n=n)
    profile = (grams.groupBy(F.col(lang_col).alias("lang"), "term")
                    .agg(F.count(F.lit(1)).alias("c")))
    # The fitted profile is a model: materialise it once in the shared
    # checkpoint folder (lineage cut, survives executor loss) instead of
    # re-deriving it from the training texts for every use.
    profile = materialize(profile)
    vocab_size = profile.select(F.countDistinct("term")).scalar()
    priors = (profile.groupBy("lang").agg(F.sum("c").alias("n_lang"))
                     .withColumn("v", vocab_size))
    return profile, priors


def detect(df: DataFrame, id_col: str, text_col: str, profile: DataFrame, priors: DataFrame,
           n: int = 3, keep: list[str] | None = None) -> DataFrame:
    """(id, [keep...], predicted, score) for every row of ``df``. Ids must be unique."""
    keep = keep or []
    # K(d): trigrams in the document, known from the row itself.
    low = F.lower(F.col(text_col))
    with_k = df.withColumn("_k", F.greatest(F.coalesce(F.length(low), F.lit(0)) - (n - 1),
                                            F.lit(0)).cast("double"))
    # One row per trigram with a count for each language, in the order of their names (a label
    # set), so an occurrence meets one row whatever the number of languages.
    found = priors.select("lang", "v").orderBy("lang").collect()
    langs, vocab_size = [r["lang"] for r in found], max([r["v"] for r in found], default=0)
    counts = profile.groupBy("term").pivot("lang", langs).agg(F.first("c"))
    logs = counts.select("term", *[F.log(F.coalesce(F.col(f"`{g}`"), F.lit(0)) + F.lit(1.0)).alias(f"_l{i}")
                                   for i, g in enumerate(langs)])
    # The fit has counted the trigrams, of at most 4 bytes a character: no need to measure the table.
    if vocab_size * (16 * (1 + len(langs)) + 4 * n) <= BROADCAST_MAX_BYTES:
        # Hot trigrams occur in most documents: looked up where they stand, nothing is shuffled.
        grams = trigram_rows(with_k, text_col, [id_col, "_k"], n=n).withColumn("tf", F.lit(1))
        matched = grams.join(F.broadcast(logs), "term")
    else:
        # Counted inside each row first; the trigram key is salted.
        bag = with_bag(with_k.select(id_col, "_k", char_ngrams(low, n).alias("_g")), "_g", "_bag",
                       keep=[id_col, "_k"])
        matched = salted_join(explode_bag(bag, "_bag", keep=[id_col, "_k"]), logs, ["term"],
                              salt_from=[id_col, "term"])
    sums = matched.groupBy(id_col, "_k").agg(*[
        F.sum(F.col("tf") * F.col(f"_l{i}")).alias(f"_s{i}") for i in range(len(langs))])
    pairs = F.array(*[F.struct(F.lit(g).alias("lang"), F.col(f"_s{i}").alias("_gain"))
                      for i, g in enumerate(langs)]) if langs else F.lit(None).cast(
        "array<struct<lang: string, _gain: double>>")
    partial = sums.select(id_col, "_k", F.inline(pairs)) if langs else sums.select(
        id_col, "_k", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("_gain"))
    # One row per language: bounded by the label set.
    pri = F.broadcast(priors.select("lang", F.log(F.col("n_lang") + F.col("v")).alias("_lognv")))
    scored = (partial.join(pri, "lang")
                     .select(id_col, "lang",
                             (F.col("_gain") - F.col("_k") * F.col("_lognv")).alias("score")))
    best_matched = scored.groupBy(id_col).agg(
        F.min(F.struct((-F.col("score")).alias("neg"), F.col("lang"))).alias("_m"))
    # Best language for a document that matches nothing: the smallest n + V
    # (two scalar subqueries over the one-row-per-language priors).
    base_lang = priors.select(F.min(F.struct(F.log(F.col("n_lang") + F.col("v")).alias("l"),
                                             F.col("lang"))).alias("b"))
    base_log = base_lang.select("b.l").scalar()
    base_name = base_lang.select("b.lang").scalar()
    docs = with_k.select(id_col, *keep, "_k").join(best_matched, id_col, "left")
    cand_base = F.struct((F.col("_k") * base_log).alias("neg"), base_name.alias("lang"))
    best = F.when(F.col("_m").isNull(), cand_base).otherwise(F.least(F.col("_m"), cand_base))
    return docs.select(id_col, *keep, best["lang"].alias("predicted"),
                       (-best["neg"]).alias("score"))


def detect_with(df: DataFrame, text_col: str, make_predict_fn, out: str = "language",
                batch_size: int = 64) -> DataFrame:
    """L2: label texts with a user model, in batches, loaded once per worker.

    ``make_predict_fn()`` returns ``fn(list[str]) -> list[str]``. A NULL text has a NULL label.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import StringType

    def make():
        fn = make_predict_fn()

        def predict(texts):
            import numpy as np
            out = np.full(len(texts), None, dtype=object)
            some = [i for i, t in enumerate(texts) if t is not None]
            out[some] = fn([str(texts[i]) for i in some]) if some else []
            return out
        return predict

    udf = predict_batch_udf(make, return_type=StringType(), batch_size=batch_size)
    return df.withColumn(out, udf(F.col(text_col)))


def bucket(term_col, bits: int = 16):
    """Bucket of a trigram: the first ``bits`` (a multiple of 4) of its md5."""
    return F.conv(F.substring(F.md5(F.col(term_col).cast("binary")), 1, bits // 4), 16, 10).cast("int")


def hashed_profile(df: DataFrame, text_col: str, lang_col: str, n: int = 3, bits: int = 16) -> dict:
    """lang -> counts of its trigrams' buckets. A model of fixed size, 2**bits numbers a language, for
    batch inference; it is that, not the profile, that reaches the driver."""
    base = df.where(F.col(lang_col).isNotNull())
    # Trigrams are counted before they are hashed.
    grams = trigram_rows(base, text_col, [lang_col], n=n).groupBy(lang_col, "term").agg(
        F.count(F.lit(1)).alias("c"))
    rows = grams.groupBy(F.col(lang_col).alias("lang"), bucket("term", bits).alias("b")).agg(
        F.sum("c").alias("c")).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["lang"], [0] * (1 << bits))[r["b"]] = int(r["c"])
    return out


def hashed_model(counts: dict, n: int = 3, bits: int = 16):
    """``make_predict_fn`` for ``detect_with``: naive Bayes over hashed trigrams, add-one smoothed."""
    def make_predict_fn():
        import hashlib

        import numpy as np

        langs = sorted(counts)
        c = np.array([counts[g] for g in langs], float)
        logs = np.log((c + 1) / (c.sum(1, keepdims=True) + c.shape[1]))
        known: dict = {}

        def bucket_of(g):
            b = known.get(g)
            if b is None:
                if len(known) > 1_000_000:
                    known.clear()
                b = known[g] = int(hashlib.md5(g.encode()).hexdigest()[:bits // 4], 16)
            return b

        def predict(texts):
            out = []
            for t in texts:
                low = t.lower()
                b = [bucket_of(low[i:i + n]) for i in range(len(low) - n + 1)]
                out.append(langs[int(logs[:, b].sum(1).argmax())])
            return out
        return predict

    return make_predict_fn
