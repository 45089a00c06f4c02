"""Label harmonisation: normalise, look up in a frozen map, summarise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.records import tidy

# Routes by which a label was mapped, reasons why it was not.
ROUTES = ("exact", "synonym", "code", "expert")
EXCLUSION_REASONS = ("out_of_scope", "too_rare", "non_specific", "unmappable")
MAP_SCHEMA = "source_dataset string, source_label string, target_class string, broad_category string, route string, icd11 string, snomed string, excluded int, exclusion_reason string"
_REQUIRED = {"source_dataset", "source_label", "target_class", "broad_category", "route"}


def normalise_label(c: Column) -> Column:
    """Lower case; underscores and slashes to spaces; other characters than a-z, 0-9, blank and hyphen deleted; blanks merged."""
    x = F.regexp_replace(tidy(c), "[_/]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9 -]", ""), " +", " "))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """Codes stay text; ``excluded`` becomes a boolean."""
    return spark.read.schema(MAP_SCHEMA).csv(path, header=True).withColumn("excluded", F.col("excluded") == 1)


def keyed(table: DataFrame) -> DataFrame:
    return table.withColumn("_dataset", tidy(F.col("source_dataset"))).withColumn("_label", normalise_label(F.col("source_label")))


def validate_label_map(table: DataFrame) -> None:
    """Raise on missing columns, unknown routes or keys that occur twice after normalisation."""
    if missing := _REQUIRED - set(table.columns):
        raise KeyError(f"missing columns: {sorted(missing)}")
    if bad := [r["route"] for r in table.filter(F.col("route").isNotNull() & ~F.col("route").isin(*ROUTES)).select("route").distinct().limit(5).collect()]:
        raise ValueError(f"unknown routes: {sorted(bad)}")
    if twice := keyed(table).groupBy("_dataset", "_label").count().filter("count > 1").limit(5).collect():
        raise ValueError(f"repeated keys: {[tuple(r)[:2] for r in twice]}")


def apply_label_map(df: DataFrame, table: DataFrame, *, dataset: str = "source_dataset", label: str = "source_label") -> DataFrame:
    """Left join on (dataset, normalised label). Unmatched rows are excluded as unmappable; excluded rows have no class.

    The map is frozen and small, but its size is left to the optimiser, which broadcasts it below its threshold.
    """
    columns = ["target_class", "broad_category", "route", "icd11", "snomed", "excluded", "exclusion_reason"]
    have = [c for c in columns if c in table.columns]
    lookup = keyed(table).select("_dataset", "_label", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_m_{c}") for c in have])
    rows = df.drop(*[c for c in columns if c in df.columns]).withColumn("_dataset", tidy(F.col(dataset))).withColumn("_label", normalise_label(F.col(label)))
    out = rows.join(lookup, ["_dataset", "_label"], "left")
    out = out.withColumn("excluded", F.coalesce(F.col("_m_excluded") if "excluded" in have else F.when(F.col("_hit"), False), F.lit(True)))
    out = out.withColumn("exclusion_reason", F.when(F.col("_hit").isNull(), F.lit("unmappable")).otherwise(F.col("_m_exclusion_reason") if "exclusion_reason" in have else F.lit(None).cast("string")))
    for c in columns[:5]:
        value = F.col(f"_m_{c}") if c in have else F.lit(None).cast("string")
        out = out.withColumn(c, F.when(~F.col("excluded"), value) if c in columns[:2] else value)
    return out.drop("_dataset", "_label", "_hit", *[f"_m_{c}" for c in have])


def label_map_summary(table: DataFrame) -> DataFrame:
    """Per category distinct classes, mapped and excluded labels; a Total row counts excluded labels without a category too."""
    flag = F.coalesce("excluded", F.lit(False))
    named = table.filter(F.col("broad_category").isNotNull())
    kept = named.filter(~flag).groupBy("broad_category").agg(F.count_distinct("target_class").alias("classes"), F.count("*").alias("mapped"))
    dropped = named.filter(flag).groupBy("broad_category").agg(F.count("*").alias("excluded"))
    rows = kept.join(dropped, "broad_category", "left").fillna(0, ["excluded"])
    total = table.agg(F.count_distinct(F.when(~flag, F.col("target_class"))).alias("classes"), F.count_if(~flag).alias("mapped"), F.count_if(flag).alias("excluded"))
    return rows.unionByName(total.select(F.lit("Total").alias("broad_category"), "classes", "mapped", "excluded"))


def inventory_labels(frames: list[DataFrame], dataset: str = "source_dataset", label: str = "source_label") -> DataFrame:
    """Distinct (dataset, raw label, normalised label) over all sources."""
    rows = reduce(DataFrame.unionByName, [f.select(F.col(dataset).alias("source_dataset"), F.col(label).alias("source_label")) for f in frames])
    return rows.withColumn("normalised", normalise_label(F.col("source_label"))).distinct()


def reject_source(df: DataFrame, name: str = "ddi", dataset: str = "source_dataset") -> DataFrame:
    """Raise if an external test source is in the manifest."""
    if not df.filter(tidy(F.col(dataset)) == name).limit(1).isEmpty():
        raise ValueError(f"the manifest holds rows of {name!r}, which is for external testing only")
    return df
