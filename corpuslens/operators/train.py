"""Feature matrices and model training on ``pyspark.ml``.

Vectors stay sparse end to end: the fitted vocabulary becomes a
``CountVectorizerModel``, the IDF (smoothed, +1) an ``ElementwiseProduct``,
rows are L2-normalised with ``Normalizer`` and the two count columns appended
with ``VectorAssembler``. Nothing is densified.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, Normalizer,
                                VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import NUMERIC_FEATURES
from .tfidf import TfidfModel


@dataclass
class FeatureSpace:
    """Fitted vocabulary + the transformer chain that builds ``features``."""

    tfidf: TfidfModel
    pipeline: PipelineModel
    numeric: tuple[str, ...] = NUMERIC_FEATURES

    @property
    def names(self) -> list[str]:
        return list(self.tfidf.terms) + list(self.numeric)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)


def tfidf_stages(model: TfidfModel, tokens_col: str, out: str) -> list:
    """Tokens -> counts -> times IDF -> L2-normalised, as sparse vectors."""
    cv = CountVectorizerModel.from_vocabulary(model.terms or ["<empty>"], inputCol=tokens_col,
                                              outputCol="_tf")
    idf = ElementwiseProduct(scalingVec=Vectors.dense(model.idfs or [0.0]), inputCol="_tf",
                             outputCol="_tfidf_raw")
    return [cv, idf, Normalizer(p=2.0, inputCol="_tfidf_raw", outputCol=out)]


def feature_space(model: TfidfModel, tokens_col: str = "tokens",
                  numeric: tuple[str, ...] = NUMERIC_FEATURES,
                  out: str = "features") -> FeatureSpace:
    stages = tfidf_stages(model, tokens_col, "_tfidf")
    if numeric:
        stages.append(VectorAssembler(inputCols=["_tfidf", *numeric], outputCol=out,
                                      handleInvalid="keep"))
    else:
        stages.append(VectorAssembler(inputCols=["_tfidf"], outputCol=out))
    return FeatureSpace(model, PipelineModel(stages=stages), tuple(numeric))


def bow_space(model: TfidfModel, tokens_col: str = "tokens",
              numeric: tuple[str, ...] = NUMERIC_FEATURES, out: str = "features") -> FeatureSpace:
    """Binary bag of words over a fitted vocabulary, plus the numeric columns (M3)."""
    cv = CountVectorizerModel.from_vocabulary(model.terms or ["<empty>"], inputCol=tokens_col,
                                              outputCol="_bow", binary=True)
    va = VectorAssembler(inputCols=["_bow", *numeric], outputCol=out, handleInvalid="keep")
    return FeatureSpace(model, PipelineModel(stages=[cv, va]), tuple(numeric))


#: Bounds of a fitted tree, whatever the rows: Spark's greatest depth, and at most this share
#: of all rows for a leaf to be split off, so at most 1 / MIN_LEAF leaves.
MAX_DEPTH = 30
MIN_LEAF = 1e-4


def forest(train: DataFrame, label: str = "label", features: str = "features",
           num_trees: int = 100, max_depth: int = MAX_DEPTH, seed: int = 42):
    """Random forest (M1). Trees grow to purity within MAX_DEPTH and MIN_LEAF, which bound the model."""
    rf = RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=num_trees,
                                maxDepth=max_depth, seed=seed, featureSubsetStrategy="sqrt",
                                impurity="gini", cacheNodeIds=True, checkpointInterval=10,
                                minWeightFractionPerNode=MIN_LEAF)
    return rf.fit(train)


def logistic(train: DataFrame, label: str = "label", features: str = "features",
             max_iter: int = 100, reg: float = 0.01):
    """Multinomial logistic regression: the linear model used for exact attributions."""
    lr = LogisticRegression(labelCol=label, featuresCol=features, maxIter=max_iter,
                            regParam=reg, family="multinomial", standardization=True)
    return lr.fit(train)


def boosted_ovr(train: DataFrame, classes: list[int], label: str = "label",
                features: str = "features", max_iter: int = 500, depth: int = 6,
                step: float = 0.3, validation_col: str | None = None, seed: int = 42,
                tol: float = 0.01, parallelism: int = 4) -> dict:
    """One binary GBT per class (M2/M3), early-stopped on ``validation_col`` rows.

    ``OneVsRest`` is avoided on purpose: its inner models carry a generated
    label column, which breaks ``evaluateEachIteration`` on them.
    """
    def fit_one(c):
        data = train.withColumn("_bin", (F.col(label) == F.lit(c)).cast("double"))
        gbt = GBTClassifier(labelCol="_bin", featuresCol=features, maxIter=max_iter,
                            maxDepth=depth, stepSize=step, seed=seed, validationTol=tol,
                            checkpointInterval=10)
        if validation_col:
            gbt = gbt.setValidationIndicatorCol(validation_col)
        return c, gbt.fit(data)

    # The per-class models are independent: fit them as concurrent Spark jobs
    # (each boosting round is a small job that leaves most cores idle).
    return dict(_parallel(fit_one, classes, parallelism))


def ovr_predict(models: dict, df: DataFrame, features: str = "features",
                out: str = "prediction") -> DataFrame:
    """Predict the class whose binary model gives the highest margin (ties: lowest class)."""
    from pyspark.ml.functions import vector_to_array

    scored = df
    cols = []
    for c, m in sorted(models.items()):
        name = f"_raw{c}"
        scored = m.setRawPredictionCol(name).setPredictionCol(f"_p{c}") \
                  .setProbabilityCol(f"_pr{c}").transform(scored)
        scored = scored.withColumn(name, vector_to_array(F.col(name))[1]).drop(f"_p{c}", f"_pr{c}")
        cols.append((c, name))
    best = F.greatest(*[F.struct(F.col(n).alias("s"), F.lit(-c).alias("neg_c")) for c, n in cols]) \
        if len(cols) > 1 else F.struct(F.col(cols[0][1]).alias("s"), F.lit(-cols[0][0]).alias("neg_c"))
    return scored.withColumn(out, (-best["neg_c"]).cast("double")).drop(*[n for _, n in cols])


def history(models: dict, df: DataFrame, label: str = "label") -> list[tuple[int, int, float]]:
    """(class, iteration, held-out log-loss of the binary model) per boosting round."""
    def one(item):
        c, m = item
        data = df.withColumn("_bin", (F.col(label) == F.lit(c)).cast("double"))
        return [(c, i + 1, float(v)) for i, v in enumerate(m.evaluateEachIteration(data))]

    return [row for rows in _parallel(one, sorted(models.items()), 4) for row in rows]


def _parallel(fn, items, parallelism: int):
    """Run ``fn`` over ``items`` from driver threads (concurrent Spark jobs)."""
    from concurrent.futures import ThreadPoolExecutor

    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(fn, items))
