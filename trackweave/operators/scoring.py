"""Classifiers on feature columns, fitted with Spark ML and scored out of fold."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.plans.stages import Stages

MODELS = {
    "gbt": lambda: GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=10, maxDepth=4, seed=1, checkpointInterval=-1),  # so few rounds need no copy of the residuals on disk
    "logistic": lambda: LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1e-3),
}


def out_of_fold(rows: DataFrame, features: list[str], label: str, fold: str, folds: int, keep: list[str], model: str = "gbt", spent: Stages | None = None) -> DataFrame:
    """(keep, score): every row scored by a model fitted on the labelled rows of the other folds.

    Null and NaN features count as 0, a null label as unlabelled.  If the other folds' labels are all alike, the
    score is their mean, and 0 where there are none.
    Every pass of every fit reads the rows, so they are written once; then ``spent``, the stages that they were made from, are closed.
    """
    rows, _ = Stages(rows.sparkSession, "folds").write(rows.select(*dict.fromkeys([*keep, fold, label, *features])), "rows")
    if spent:
        spent.close()
    filled = rows.select(*keep, fold, label, *(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features))
    x = VectorAssembler(inputCols=features, outputCol="_x").transform(filled).withColumn("_y", F.col(label).cast("double"))
    out = None
    for k in range(folds):
        known = x.where((F.col(fold) != k) & F.col("_y").isNotNull())
        low, high = known.agg(F.min("_y"), F.max("_y")).first()
        part = x.where(F.col(fold) == k)
        if low == high:
            scored = part.withColumn("score", F.lit(float(low or 0.0)))
        else:
            scored = MODELS[model]().fit(known).transform(part).withColumn("score", vector_to_array("probability")[1])
        scored = scored.select(*keep, "score")
        out = scored if out is None else out.unionByName(scored)
    return out
