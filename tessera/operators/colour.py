"""Colour constancy on pixel rows: Minkowski mean illuminant, von Kries gains; geometry of resizing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Minkowski order and the short side that images are reduced to.
ORDER = 6
SHORT_SIDE = 512
CHANNELS = ("r", "g", "b")


def as_unit(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Channels in [0, 1]: divided by 255 only for images with a value above 1."""
    missing = {image, *CHANNELS} - set(pixels.columns)
    if missing:
        raise ValueError(f"three channels are needed; missing {sorted(missing)}")
    top = F.max(F.greatest(*CHANNELS)).over(Window.partitionBy(image))
    scale = F.when(top > 1, 255.0).otherwise(1.0)
    return pixels.select(*[c for c in pixels.columns if c not in CHANNELS], *[(F.col(c) / scale).alias(c) for c in CHANNELS])


def _unit(raw: list[Column]) -> list[Column]:
    norm = F.sqrt(sum(x * x for x in raw))
    return [F.when(norm > 0, F.try_divide(x, norm)).otherwise(1 / math.sqrt(3)) for x in raw]


def illuminant(pixels: DataFrame, image: str = "image_id", order: int = ORDER) -> DataFrame:
    """Unit vector (er, eg, eb) of each image; grey for a black image."""
    means = pixels.groupBy(image).agg(*[F.pow(F.avg(F.pow(F.col(c), F.lit(float(order)))), F.lit(1.0 / order)).alias(f"_{c}") for c in CHANNELS])
    return means.select(image, *[e.alias(f"e{c}") for c, e in zip(CHANNELS, _unit([F.col(f"_{c}") for c in CHANNELS]), strict=True)])


def gain(e: Column) -> Column:
    return (1 / math.sqrt(3)) / F.greatest(e, F.lit(1e-8))


def von_kries(pixels: DataFrame, light: DataFrame, image: str = "image_id") -> DataFrame:
    out = pixels.join(light, image)
    return out.select(*[c for c in pixels.columns if c not in CHANNELS], *[F.least(F.greatest(F.col(c) * gain(F.col(f"e{c}")), F.lit(0.0)), F.lit(1.0)).alias(c) for c in CHANNELS])


def shades_of_gray(pixels: DataFrame, image: str = "image_id", order: int = ORDER) -> DataFrame:
    """Corrected pixels. Means are combined before the shuffle, so an image's pixels are not gathered in one task."""
    return von_kries(pixels, illuminant(pixels, image, order), image)


def resized(width: Column, height: Column, short: int = SHORT_SIDE) -> Column:
    """struct(width, height) after the short side is reduced to ``short``; images are never enlarged."""
    scale = F.lit(float(short)) / F.least(width, height)
    new = lambda x: F.when(scale < 1, F.rint(x * scale)).otherwise(x).cast("int")
    return F.struct(new(width).alias("width"), new(height).alias("height"))
