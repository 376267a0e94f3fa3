"""Vocabulary, IDF and TF-IDF.

Definitions (fixed to match the reference's vectoriser defaults):
* tokens: lowercase runs of >= 2 word characters (``functions.text.vector_terms``);
* df: documents of the scope containing the term; tf: its total count;
* terms with df < ``min_df`` are dropped, then the ``max_features`` terms with
  the largest tf are kept (ties: term ascending);
* idf = ln((1 + n) / (1 + df)) + 1 with n = documents in the scope (smoothed);
* document vectors: raw count x idf, L2-normalised per document.

Plan shape: each document emits its tokens and its distinct tokens
(``functions.text.term_counts``), then one map-side-combined aggregation by
(scope, term) gives df and tf; no per-document shuffle. The vocabulary cut is read off
a histogram of the tf (``topk.top_counts``). Per-class fits are one pass over the data for all
classes, and ``idf_scopes`` adds the global scope to the same pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import term_counts, vector_terms  # noqa: F401  vector_terms: for callers
from .topk import top_counts, top_k

GLOBAL = "__all__"


def term_stats(df: DataFrame, tokens_col: str, class_col: str | None = None) -> DataFrame:
    """(class, term, df, tf) over all documents of each class (one shuffle)."""
    scope = F.col(class_col) if class_col else F.lit(GLOBAL)
    base = df.select(scope.alias("class"), F.col(tokens_col))
    if class_col:
        base = base.where(F.col("class").isNotNull())
    return term_counts(base, tokens_col, ["class"])


def doc_counts(df: DataFrame, class_col: str | None = None) -> DataFrame:
    """(class, n_docs): documents per scope, including documents without tokens."""
    scope = F.col(class_col) if class_col else F.lit(GLOBAL)
    out = df.select(scope.alias("class"))
    if class_col:
        out = out.where(F.col("class").isNotNull())
    return out.groupBy("class").agg(F.count(F.lit(1)).alias("n_docs"))


def idf_by(df: DataFrame, tokens_col: str = "tokens", class_col: str | None = None,
           min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """Fitted vocabulary per scope: (class, term, df, tf, n_docs, idf).

    ``class_col=None`` fits one global vocabulary (class = ``GLOBAL``).
    """
    return _vocab(term_stats(df, tokens_col, class_col), doc_counts(df, class_col),
                  min_df, max_features)


def idf_scopes(df: DataFrame, tokens_col: str, class_col: str, min_df: int = 1,
               max_features: int | None = None) -> DataFrame:
    """Per-class and global vocabularies in one table from one pass over the tokens.

    Each (document, term) row counts for its class and for the global scope
    (``class = GLOBAL``): one aggregation, one ranking window (partitioned by
    scope) and one scan serve both, instead of tokenising and shuffling the
    corpus twice. Documents with a NULL class are left out of both scopes.
    """
    base = df.where(F.col(class_col).isNotNull()).select(
        F.explode(F.array(F.col(class_col), F.lit(GLOBAL))).alias("class"), F.col(tokens_col))
    stats = term_counts(base, tokens_col, ["class"])
    counts = (df.where(F.col(class_col).isNotNull())
                .select(F.explode(F.array(F.col(class_col), F.lit(GLOBAL))).alias("class"))
                .groupBy("class").agg(F.count(F.lit(1)).alias("n_docs")))
    return _vocab(stats, counts, min_df, max_features)


def _vocab(stats: DataFrame, counts: DataFrame, min_df: int,
           max_features: int | None) -> DataFrame:
    stats = stats.where(F.col("df") >= F.lit(min_df))
    if max_features is not None:
        stats = top_counts(stats, "class", "tf", "term", max_features)
    # One row per class: bounded by the label set, so broadcasting it is safe.
    return (stats.join(F.broadcast(counts), "class")
                 .withColumn("idf", F.log((F.lit(1.0) + F.col("n_docs")) /
                                          (F.lit(1.0) + F.col("df"))) + F.lit(1.0)))


def idf(df: DataFrame, tokens_col: str = "tokens", min_df: int = 1,
        max_features: int | None = None) -> DataFrame:
    """Global vocabulary: (term, df, tf, n_docs, idf)."""
    return idf_by(df, tokens_col, None, min_df, max_features).drop("class")


def top_terms(vocab: DataFrame, n: int = 10, by: str = "idf") -> DataFrame:
    """Top ``n`` terms per class by ``by`` descending (ties: term ascending)."""
    return top_k(vocab, ["class"], [F.col(by).desc(), F.col("term").asc()], n,
                 rank_col="rank", salt_on=["term"])


@dataclass
class TfidfModel:
    """A fitted global vocabulary, small enough to broadcast.

    ``terms``/``idfs`` are collected only because ``max_features`` bounds them;
    this is what an ML vectoriser does with its vocabulary.
    """

    terms: list[str]
    idfs: list[float]

    @property
    def size(self) -> int:
        return len(self.terms)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, float(v)) for i, (t, v) in enumerate(zip(self.terms, self.idfs))]
        return spark.createDataFrame(rows, "feature_idx int, term string, idf double")


def fit(df: DataFrame, tokens_col: str = "tokens", max_features: int = 1000,
        min_df: int = 1, max_terms: int = 1_000_000) -> TfidfModel:
    """Fit a bounded global vocabulary (sorted by term, like the reference)."""
    if max_features is None or max_features > max_terms:
        raise ValueError("fit() ships the vocabulary to tasks: max_features must be "
                         f"set and <= {max_terms}; use idf_by() for unbounded tables")
    # The cut reads the counts twice: kept, so that the rows are counted once.
    stats = term_stats(df, tokens_col).persist(StorageLevel.MEMORY_AND_DISK)
    vocab = _vocab(stats, doc_counts(df), min_df, max_features).select("term", "idf")
    rows = sorted(vocab.collect(), key=lambda r: r.term)
    stats.unpersist()
    return TfidfModel([r.term for r in rows], [r.idf for r in rows])


def long_weights(df: DataFrame, model: TfidfModel, id_col: str, tokens_col: str = "tokens",
                 extra: list[str] | None = None) -> DataFrame:
    """(id, [extra...], term, feature_idx, weight): one row per non-zero entry.

    Counting, the lookup in the vocabulary (bounded by ``max_features``), the weights and the
    L2 norm all happen inside each row, on sparse vectors; the entries are exploded last and
    nothing is shuffled.
    """
    from .train import tfidf_stages

    extra = extra or []
    keep = [id_col, *extra]
    rows = df.select(*keep, F.coalesce(tokens_col, F.array().cast("array<string>")).alias(tokens_col))
    for stage in tfidf_stages(model, tokens_col, "_tfidf"):
        rows = stage.transform(rows)
    vec = F.unwrap_udt("_tfidf")
    entries = rows.select(*keep, F.inline_outer(F.arrays_zip(
        vec["indices"].alias("feature_idx"), vec["values"].alias("weight"))))
    terms = F.broadcast(model.vocabulary(df.sparkSession).select("feature_idx", "term"))
    return (entries.where(F.col("feature_idx").isNotNull()).join(terms, "feature_idx")
            .select(*keep, "term", "feature_idx", "weight"))


def class_centroid(df: DataFrame, model: TfidfModel, id_col: str, class_col: str,
                   tokens_col: str = "tokens") -> DataFrame:
    """Mean TF-IDF weight per (class, term); absent terms count as 0.

    The sum runs over non-zero entries only and is divided by all documents of
    the class, so the dense matrix is never built.
    """
    base = df.where(F.col(class_col).isNotNull())
    long = long_weights(base, model, id_col, tokens_col, extra=[class_col])
    sums = long.groupBy(F.col(class_col).alias("class"), "term").agg(
        F.sum("weight").alias("_sum"))
    n = F.broadcast(doc_counts(base, class_col))
    return (sums.join(n, "class")
                .select("class", "term", (F.col("_sum") / F.col("n_docs")).alias("mean_tfidf")))
