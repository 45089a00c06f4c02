"""Skin tone from CIE-Lab pixels: individual typology angle, its class, confidence and precedence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper-inclusive bins (low, high, class, group, band) of the angle in degrees, and the band boundary.
BINS = (
    (55.0, float("inf"), "very light", "I-II", "lighter"),
    (41.0, 55.0, "light", "II-III", "lighter"),
    (28.0, 41.0, "intermediate", "III", "lighter"),
    (10.0, 28.0, "tan", "IV", "darker"),
    (-30.0, 10.0, "brown", "V", "darker"),
    (float("-inf"), -30.0, "dark", "VI", "darker"),
)
BOUNDARY = 28.0
METHOD = "ita_cielab_meanLb"


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def ita(lightness: Column, b: Column) -> Column:
    """Angle in degrees; null where b is nearly zero. atan, not atan2: the sign of b matters."""
    return F.when(F.abs(b) >= 1e-8, F.degrees(F.atan((lightness - 50) / b)))


def classify(angle: Column) -> Column:
    """struct(chardon, fitzpatrick_group, band); unless the angle is finite, no class and no group, and the band is ``uncertain``."""
    parts = []
    for place, name, unknown in ((2, "chardon", None), (3, "fitzpatrick_group", None), (4, "band", "uncertain")):
        c = F.when(~finite(angle), F.lit(unknown).cast("string"))
        for row in BINS[:-1]:
            c = c.when(angle > row[0], row[place])
        parts.append(c.otherwise(BINS[-1][place]).alias(name))
    return F.struct(*parts)


def confidence(n: Column, iqr: Column, angle: Column, min_pixels: float = 5000, max_iqr: float = 12.0, min_margin: float = 3.0) -> Column:
    """struct(score, level): mean of three clipped parts; ``high`` only if all three raw thresholds hold."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    margin = F.when(finite(angle), F.abs(angle - BOUNDARY)).otherwise(0.0)
    iqr = F.coalesce(iqr, F.lit(float("inf")))
    spread = clip(1 - iqr / max_iqr) if max_iqr > 0 else F.lit(0.0)
    score = (clip(n / max(min_pixels, 1)) + spread + clip(margin / max(min_margin, 1e-8))) / 3
    high = (n >= min_pixels) & (iqr <= max_iqr) & (margin >= min_margin)
    return F.struct(F.when(n > 0, score).otherwise(0.0).alias("score"), F.when(high & (n > 0), "high").otherwise("low").alias("level"))


def estimate(pixels: DataFrame, image: str = "image_id", lightness: str = "L", b: str = "b", **thresholds) -> DataFrame:
    """Per image: ita (of mean L and mean b), iqr of pixel angles, n, class, confidence, method. One shuffle on the image."""
    angles = pixels.withColumn("_ita", ita(F.col(lightness), F.col(b)))
    per = angles.groupBy(image).agg(F.avg(lightness).alias("mean_l"), F.avg(b).alias("mean_b"), F.percentile("_ita", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count("*").alias("n_skin_pixels"))
    per = per.withColumn("ita", ita(F.col("mean_l"), F.col("mean_b"))).withColumn("iqr", F.col("_q")[1] - F.col("_q")[0])
    per = per.withColumn("_c", confidence(F.col("n_skin_pixels"), F.col("iqr"), F.col("ita"), **thresholds)).withColumn("_k", classify(F.col("ita")))
    return per.select(image, "ita", "iqr", "n_skin_pixels", "_k.chardon", "_k.fitzpatrick_group", "_k.band", F.col("_c.score").alias("confidence"), F.col("_c.level").alias("confidence_level"), F.lit(METHOD).alias("method"))


def resolve(source_band: Column, ita_band: Column, level: Column) -> Column:
    """struct(band, provenance, ita_band, disagrees): the source's band, else a confident angle's, else uncertain; the angle's band is kept beside it."""
    known = lambda c: F.coalesce(c.isin("lighter", "darker"), F.lit(False))
    use = known(ita_band) & F.coalesce(level == "high", F.lit(False))
    return F.struct(
        F.when(known(source_band), source_band).when(use, ita_band).otherwise("uncertain").alias("band"),
        F.when(known(source_band), "source").when(use, "ita_high_confidence").otherwise("none").alias("provenance"),
        F.coalesce(ita_band, F.lit("uncertain")).alias("ita_band"),
        F.coalesce(known(source_band) & known(ita_band) & (source_band != ita_band), F.lit(False)).alias("disagrees"),
    )
