"""Controlled training sets: feasible size, stratified draws without replacement, the ladder of settings, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.portable import uniform_key


# The settings of the ladder and the comparisons (treatment, comparator, question).
LADDER_SCHEMA = "name string, title string, harmonised boolean, colour_constancy boolean, sampling string, tone_weighted_loss boolean, matched_size boolean, question string"
LADDER_ROWS = (
    ("A0", "Original baseline", False, False, "natural", False, False, "Reference from the first submission"),
    ("A1", "Controlled baseline", True, False, "natural", False, True, "Effect of harmonisation and clean splits"),
    ("A2", "+ Colour constancy", True, True, "natural", False, True, "Effect of colour constancy alone"),
    ("A3", "+ Balancing", True, False, "balanced", False, True, "Effect of skin-tone balancing alone"),
    ("A4", "Full pipeline, matched size", True, True, "balanced", False, True, "Combined effect at fixed size"),
    ("A5", "Full corpus", True, True, "as_released", False, False, "Effect of additional data"),
    ("A6", "Loss re-weighting", True, True, "natural", True, True, "Data-level against loss-level correction"),
)
#: Setting -> its sampling rule.
LADDER = {row[0]: row[4] for row in LADDER_ROWS}
COMPARISONS = (
    ("A1", "A0", "harmonisation and clean splitting"),
    ("A2", "A1", "colour constancy alone"),
    ("A3", "A1", "skin-tone balancing alone"),
    ("A4", "A2", "balancing with colour constancy enabled"),
    ("A5", "A4", "additional training data"),
    ("A6", "A2", "loss-level against data-level correction"),
)
SEEDS = (2026, 2027, 2028, 2029, 2030)
# The training presets, as (backbone, pre-training, learning rate, batch size), and what all share.
PRESETS = (("vit_b_16", "imagenet21k_to_1k", 5e-5, 16), ("resnet50", "imagenet1k_v2", 1e-4, 32))
SHARED = {
    "input_size": 224, "optimiser": "adamw", "schedule": "cosine", "warmup_epochs": 5, "weight_decay": 1e-2, "max_epochs": 50, "patience": 7, "loss": "cross_entropy",
    "class_weighting": "inverse_frequency", "augmentation": "random_resized_crop,horizontal_flip,rotation_15,brightness_contrast_mild", "amp": True, "num_classes": 25, "select_on": "val_macro_auroc",
}


def ladder(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LADDER_ROWS), LADDER_SCHEMA)


def training_presets(spark: SparkSession) -> DataFrame:
    """A row a (backbone, setting): its preset, what all share, and the setting's colour constancy and loss."""
    presets = spark.createDataFrame(list(PRESETS), "backbone string, pretrained string, learning_rate double, batch_size int")
    shared = [F.lit(v).alias(k) for k, v in SHARED.items()]
    settings = ladder(spark).select(F.col("name").alias("setting"), "colour_constancy", "tone_weighted_loss")
    return presets.join(settings, F.lit(True)).select("setting", *presets.columns, "colour_constancy", "tone_weighted_loss", *shared, F.array(*[F.lit(s) for s in SEEDS]).alias("seeds"))  # a few fixed rows


def available_comparisons(spark: SparkSession, settings: DataFrame, column: str = "setting") -> DataFrame:
    """Comparisons whose both settings were run."""
    table = spark.createDataFrame(list(COMPARISONS), "treatment string, comparator string, question string")
    have = settings.select(F.col(column).alias("s")).distinct()
    return table.join(have, table["treatment"] == have["s"], "left_semi").join(have, table["comparator"] == have["s"], "left_semi")


def class_caps(pool: DataFrame, *, label: str = "disease_label", band: str = "band", darker_share: float = 0.5) -> DataFrame:
    dark, light = F.count_if(F.col(band) == "darker"), F.count_if(F.col(band) == "lighter")
    cap = F.least(dark / F.lit(darker_share) if darker_share else F.lit(float("inf")), light / F.lit(1 - darker_share) if darker_share < 1 else F.lit(float("inf")))
    return pool.filter(F.col(label).isNotNull()).groupBy(label).agg(dark.alias("darker"), light.alias("lighter"), cap.alias("cap"))


def max_feasible_n(pool: DataFrame, *, label: str = "disease_label", band: str = "band", darker_share: float = 0.5) -> DataFrame:
    """One row: max_n, binding_class (the first of the least caps), n_classes, total."""
    caps = class_caps(pool, label=label, band=band, darker_share=darker_share)
    out = caps.agg(F.floor(F.min("cap")).cast("long").alias("max_n"), F.min_by(label, F.struct("cap", label)).alias("binding_class"), F.count("*").alias("n_classes"))
    return out.withColumn("total", F.col("max_n") * F.col("n_classes"))


def sample_training_set(pool: DataFrame, n_per_class: int | None, sampling: str, *, row_id: str, label: str = "disease_label", band: str = "band", darker_share: float = 0.5, seed: int = 2026) -> DataFrame:
    """Draw without replacement: ``natural`` n of each class, ``balanced`` the darker share of n and the rest lighter, ``as_released`` all.

    A draw depends on (seed, row id) alone, and so does the order of the drawn rows, which mixes the classes. If any class is
    short, nothing is drawn and the shortfalls are listed.
    """
    if sampling == "as_released":
        return pool
    if sampling not in ("natural", "balanced"):
        raise ValueError(f"unknown sampling rule {sampling!r}")
    if not n_per_class:
        raise ValueError("a number of rows per class is needed")
    rows = pool.filter(F.col(label).isNotNull())
    dark = round(n_per_class * darker_share)
    if sampling == "natural":
        keys, want, most = [label], F.lit(n_per_class), n_per_class
        short = rows.groupBy(label).agg(F.count("*").alias("have")).filter(F.col("have") < n_per_class)
        said = F.format_string("%s has %d of %d", F.col(label).cast("string"), F.col("have"), F.lit(n_per_class))
    else:
        keys, want, most = [label, band], F.when(F.col(band) == "darker", dark).otherwise(n_per_class - dark), max(dark, n_per_class - dark)
        short = class_caps(rows, label=label, band=band).filter((F.col("darker") < dark) | (F.col("lighter") < n_per_class - dark))
        said = F.format_string("%s has %d darker, %d lighter", F.col(label).cast("string"), F.col("darker"), F.col("lighter"))
        rows = rows.filter(F.col(band).isin("lighter", "darker"))
    if found := [r[0] for r in short.orderBy(label).limit(5).select(said).collect()]:
        raise ValueError(f"too few rows: {'; '.join(found)}")
    order = Window.partitionBy(*keys).orderBy(uniform_key(seed, F.col(row_id)), row_id)
    # ``most`` is a constant, so each partition passes on no more than that of a class.
    return rows.withColumn("_place", F.row_number().over(order)).filter((F.col("_place") <= most) & (F.col("_place") <= want)).drop("_place").orderBy(uniform_key(seed, "order", F.col(row_id)), row_id)


def composition(rows: DataFrame, band: str = "band") -> DataFrame:
    resolved = F.col(band).isin("lighter", "darker")
    return rows.agg(F.count("*").alias("n_rows"), F.round(F.avg(F.when(resolved, (F.col(band) == "darker").cast("double"))) * 100, 1).alias("darker_percent"))


def build_ablation(name: str, pool: DataFrame, n_per_class: int | None = None, seed: int = 2026, **columns) -> DataFrame:
    """One rung's rows with its name. Rungs other than ``as_released`` need a size; that A0 would draw nothing without one is an error here."""
    return sample_training_set(pool, n_per_class, LADDER[name], seed=seed, **columns).withColumn("setting", F.lit(name))


def class_weights(df: DataFrame, n_classes: int, label: str = "label") -> DataFrame:
    """(label, n, weight): total / (classes x count), counts of 0 taken as 1 before the total."""
    counted = df.groupBy(F.col(label).cast("long").alias("label")).agg(F.count("*").alias("n"))
    filled = df.sparkSession.range(n_classes).withColumnRenamed("id", "label").join(counted, "label", "left").select("label", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"))
    return filled.withColumn("weight", F.sum("n").over(Window.partitionBy()) / (F.lit(n_classes) * F.col("n")))


def tone_weights(df: DataFrame, n_classes: int, label: str = "label", band: str = "band") -> DataFrame:
    """``df`` with a weight a row: its class weight, times rows / (2 x rows of its band) for resolved bands."""
    per_class = class_weights(df, n_classes, label).select(F.col("label").alias("_c"), "weight")  # a row a class
    bands = df.groupBy(F.col(band).alias("_b")).agg(F.count("*").alias("_nb"))  # a row a band
    bands = bands.withColumn("_n", F.sum("_nb").over(Window.partitionBy()))
    rows = df.join(per_class, F.col(label).cast("long") == F.col("_c")).join(bands, F.col(band).eqNullSafe(F.col("_b")))
    scale = F.when(F.col(band).isin("lighter", "darker"), F.col("_n") / (2 * F.col("_nb"))).otherwise(1.0)
    return rows.withColumn("weight", F.col("weight") * scale).drop("_c", "_b", "_nb", "_n")
