"""Metadata records: scan, cleaning, bands of an ordinal skin-type scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Types of the lighter and darker bands, the adequacy floor, quality flags that drop a row.
LIGHTER = (1, 2, 3)
DARKER = (4, 5, 6)
FLOOR = 20
BAD_FLAGS = ("mislabelled", "mislabeled", "wrong", "1", "true")
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6}


def tidy(c: Column) -> Column:
    return F.lower(F.trim(c))


def band(scale: Column) -> Column:
    """Two bands: every type that is not lighter is darker."""
    return F.when(scale.isin(*LIGHTER), "lighter").otherwise("darker")


def band_or_uncertain(value: Column, text: bool) -> Column:
    """Band of a type given as a number or as text (digits or roman numerals); ``uncertain`` for anything else.

    Text must be a whole number ("3.0" is not); a fractional number is truncated.
    """
    if text:
        numerals = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
        digits = F.when(F.trim(value).rlike("^[+-]?[0-9]{1,9}$"), F.trim(value))
        number = F.coalesce(digits.cast("int"), F.try_element_at(numerals, tidy(value)))
    else:
        number = F.when(~F.isnan(value.cast("double")), F.floor(value.cast("double")))
    return F.when(number.isin(*LIGHTER), "lighter").when(number.isin(*DARKER), "darker").otherwise("uncertain")


def clean(df: DataFrame, *, scale: str = "fitzpatrick_scale", condition: str = "label", category: str | None = None, qc: str | None = None) -> DataFrame:
    """Rows with a numeric type from 1 to 6 and no bad quality flag, with fitzpatrick, condition and category.

    Fractional types are truncated. The filters sit on scan columns, so they reach the reader.
    """
    missing = {c for c in (scale, condition) if c not in df.columns}
    if missing:
        raise KeyError(f"missing columns: {sorted(missing)}")
    number = F.expr(f"try_cast(`{scale}` AS DOUBLE)")
    kept = df.filter(number.between(1, 6))
    if qc and qc in df.columns:
        kept = kept.filter(~F.coalesce(tidy(F.col(qc).cast("string")).isin(*BAD_FLAGS), F.lit(False)))
    out = kept.withColumn("fitzpatrick", number.cast("int")).withColumn("condition", tidy(F.col(condition).cast("string")))
    if category and category in df.columns:
        out = out.withColumn("category", tidy(F.col(category).cast("string")))
    return out.withColumn("band", band(F.col("fitzpatrick")))


def load_metadata(spark: SparkSession, path: str, **columns) -> DataFrame:
    """Scan a metadata CSV, every column as text (so codes and flags keep their spelling), and clean it."""
    return clean(spark.read.csv(path, header=True, inferSchema=False), **columns)


def bookkeeping(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: n_raw, n_kept, n_removed."""
    a, b = raw.agg(F.count("*").alias("n_raw")), cleaned.agg(F.count("*").alias("n_kept"))
    return a.join(b, F.lit(True)).withColumn("n_removed", F.col("n_raw") - F.col("n_kept"))
