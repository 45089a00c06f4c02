"""Linear probe: standardised features, multinomial logistic regression, class probabilities (Spark ML)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_probe(train: DataFrame, test: DataFrame, *, features: str = "features", label: str = "label", max_iter: int = 1000, c: float = 1.0) -> DataFrame:
    """``test`` with ``probs``, one entry a class 0..K-1. Deterministic: a seed would change nothing."""
    vector = lambda df: df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    train = vector(train).withColumn("_y", F.col(label).cast("double"))
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(train)
    n = train.count()
    model = LogisticRegression(featuresCol="_z", labelCol="_y", family="multinomial", regParam=1.0 / (c * n), standardization=False, maxIter=max_iter, probabilityCol="_p").fit(scaler.transform(train))
    return model.transform(scaler.transform(vector(test))).withColumn("probs", vector_to_array("_p")).drop("_x", "_z", "_p", "rawPrediction", "prediction")
