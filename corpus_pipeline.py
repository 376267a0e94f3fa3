"""From documents to training sequences: the stages, each an operator of corpuslens.llm.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, is written as Parquet
and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import langid, neardup, packing, pii, quality
from corpuslens.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language less probable than this counts as not identified.
LEAST_SCORE = 0.5


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what importance resampling draws for the texts labelled as good."""
    found = quality.resample(docs.select(*COLUMNS),
                             table(spark, sf_dir, "labels", "doc_id", "quality"))
    return found.where("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of which the language can be told; the model learns from their labels."""
    pieces = langid.vocabulary(_tokenizer("piece_bpe_32k.model"))
    model = langid.train(docs, pieces)
    found = langid.identify(docs.select(*COLUMNS), model, pieces)
    return found.where((F.col("lang_pred") != langid.UNKNOWN)
                       & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return neardup.first_of_groups(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes personal data as its kind; ``n_chars`` follows the text."""
    masked = pii.mask(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with their token ids."""
    return packing.pack(docs, _tokenizer("byte_bpe_50k.tiktoken"), _tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("neardup", neardup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
