"""Prediction sources: partitioned Parquet, archives named <setting>_seed<n>.npz, and a synthetic generator."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.portable import uniform_int

_NAME = r"(A\d)_seed(\d+)\.npz$"
SCHEMA = "setting string, seed int, row_id long, y_true int, band string, `group` long, probs array<double>"


def load_archives(spark: SparkSession, folder: str, group_column: str = "band") -> DataFrame:
    """Read every archive of a folder through Spark (any file system); other names are skipped. ``group_column`` may be an external group."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder)
    files = files.select(F.regexp_extract("path", _NAME, 1).alias("setting"), F.regexp_extract("path", _NAME, 2).alias("seed"), "content").filter("setting <> ''")

    def unpack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for setting, seed, content in zip(pdf["setting"], pdf["seed"], pdf["content"], strict=True):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                n = len(data["y_true"])
                yield pd.DataFrame({
                    "setting": setting, "seed": int(seed), "row_id": np.arange(n), "y_true": data["y_true"].astype("int32"), "band": data[group_column].astype(str),
                    "group": data["group"].astype("int64") if "group" in data else np.arange(n), "probs": list(data["probs"].astype(float)),
                })

    return files.mapInPandas(unpack, SCHEMA)


def synthetic(spark: SparkSession, *, n: int = 1800, n_classes: int = 12, n_groups: int = 1400, darker_share: float = 0.384, settings=("A0", "A1"), seeds=(2026,), skill: float = 0.6) -> DataFrame:
    """Repeatable predictions: labels, bands and groups depend on the row alone, scores on (setting, seed, row, class)."""
    part = lambda *key: uniform_int(1 << 20, *key) / F.lit(float(1 << 20))
    rows = spark.range(n).select(
        F.col("id").alias("row_id"), uniform_int(n_classes, "label", F.col("id")).cast("int").alias("y_true"), uniform_int(n_groups, "group", F.col("id")).alias("group"),
    )
    rows = rows.withColumn("band", F.when(part("band", F.col("group")) < darker_share, "darker").otherwise("lighter"))
    runs = spark.createDataFrame([(s, k) for s in settings for k in seeds], "setting string, seed int")
    rows = rows.join(runs, F.lit(True))  # a copy of the test set for each run
    raw = F.array(*[part(F.col("setting"), F.col("seed"), F.col("row_id"), c) + F.when(F.col("y_true") == c, F.when(F.col("band") == "lighter", skill).otherwise(skill * 0.8)).otherwise(0.0) for c in range(n_classes)])
    rows = rows.withColumn("_raw", raw)
    total = F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x)
    return rows.select("setting", "seed", "row_id", "y_true", "band", "group", F.transform("_raw", lambda x: x / total).alias("probs"))


_PAIR = r"([^/]+)_(train|test)\.npz$"


def load_feature_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(variant, part, row_id, features, label, band) of archives named <variant>_train.npz and <variant>_test.npz.

    A variant that lacks one of the two is skipped; ``band`` is null where an archive has none. Read through Spark, so any file system does.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder)
    files = files.select(F.regexp_extract("path", _PAIR, 1).alias("variant"), F.regexp_extract("path", _PAIR, 2).alias("part"), "content").filter("part <> ''")
    whole = files.groupBy("variant").agg(F.count_distinct("part").alias("parts")).filter("parts = 2").select("variant")

    def unpack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for variant, part, content in zip(pdf["variant"], pdf["part"], pdf["content"], strict=True):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                n = len(data["labels"])
                yield pd.DataFrame({
                    "variant": variant, "part": part, "row_id": np.arange(n), "features": list(data["features"].astype(float)),
                    "label": data["labels"].astype("int32"), "band": data["band"].astype(str) if "band" in data else None,
                })

    return files.join(F.broadcast(whole), "variant", "left_semi").select("variant", "part", "content").mapInPandas(unpack, "variant string, part string, row_id long, features array<double>, label int, band string")  # a row a variant


def load_features(spark: SparkSession, path: str) -> DataFrame | None:
    """Feature rows of one variant and split (Parquet), or None where they are missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def load_anchors(spark: SparkSession, path: str | None) -> list[tuple[float, float]]:
    from tessera.operators.curve import ANCHORS

    if path is None:
        return list(ANCHORS)
    return [tuple(r) for r in spark.read.schema("n double, macro_f1 double").csv(path, header=True).orderBy("n").collect()]


def load_config(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)
