"""Structured reports: every field has a value and a provenance tag. Validation and coverage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_RECORDED = "not recorded"
# Report fields and the provenance tags permitted for each.
FIELDS = {
    "case_id": "C", "source_dataset": "S", "source_label": "S", "disease_label": "CE", "diagnosis_certainty": "S",
    "fitzpatrick_source": "S", "ita_value": "C", "ita_confidence": "C", "analysis_band": "CE", "anatomical_site": "ES",
    "age_band": "S", "sex": "S", "lesion_morphology": "ES", "image_quality_flags": "C", "caption_template": "C",
    "caption_lm": "L", "validation_status": "E",
}
SCHEMA_REQUIRED = ("case_id", "source_dataset", "disease_label", "analysis_band")
REQUIRED = ("case_id", "disease_label", "analysis_band")
#: Untrusted reports: a map, so that unknown fields can be seen.
REPORT = "map<string,struct<value:string,provenance:string>>"


def field(value: Column, tag: str) -> Column:
    if tag not in {t for tags in FIELDS.values() for t in tags}:
        raise ValueError(f"unknown provenance tag {tag!r}")
    return F.struct(F.coalesce(value.cast("string"), F.lit(NOT_RECORDED)).alias("value"), F.lit(tag).alias("provenance"))


# Tags under which a build records each field (image_quality_flags is never built).
_BUILT = {k: v[0] for k, v in FIELDS.items() if k != "image_quality_flags"} | {"anatomical_site": "S", "lesion_morphology": "S"}


def build_report(df: DataFrame, columns: dict[str, Column], out: str = "report") -> DataFrame:
    """Adds a report of 16 fields; a field without a column is not recorded."""
    entries = [x for name, tag in _BUILT.items() for x in (F.lit(name), field(columns.get(name, F.lit(None)), tag))]
    return df.withColumn(out, F.create_map(*entries))


def value_of(report: Column, name: str) -> Column:
    return F.try_element_at(report, F.lit(name))["value"]


def problems(report: Column) -> Column:
    """Array of violations; empty if the report is valid."""
    allowed = F.create_map(*[F.lit(x) for k, v in FIELDS.items() for x in (k, v)])

    def of(entry: Column) -> Column:
        name, tag = entry["key"], entry["value"]["provenance"]
        tags = F.try_element_at(allowed, name)
        listed = F.concat(F.lit("["), F.array_join(F.transform(F.split(tags, ""), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
        wrong = F.concat(name, F.lit(": provenance '"), tag, F.lit("' not permitted (allowed: "), listed, F.lit(")"))
        by_model = (tag == "L") & ~F.contains(tags, F.lit("L"))
        return (
            F.when(tags.isNull(), F.array(F.concat(F.lit("unknown field: "), name)))
            .when(tag.isNull(), F.array(F.concat(name, F.lit(": missing provenance tag"))))
            .otherwise(F.array_compact(F.array(F.when(~F.contains(tags, tag), wrong), F.when(by_model, F.concat(name, F.lit(": language model may not write a structured field"))))))
        )

    missing = F.array_compact(F.array(*[F.when(~F.map_contains_key(report, F.lit(r)), f"missing required field: {r}") for r in REQUIRED]))
    return F.concat(F.flatten(F.transform(F.map_entries(report), of)), missing)


def validate(df: DataFrame, report: str = "report") -> DataFrame:
    """Gate: raise if any report has a violation."""
    bad = df.select(problems(F.col(report)).alias("p")).filter(F.size("p") > 0).limit(1).collect()
    if bad:
        raise ValueError(f"provenance violations: {bad[0]['p'][:5]}")
    return df


def coverage(df: DataFrame, report: str = "report") -> DataFrame:
    """(field, present, percent, tags) for all 17 fields; a value that is not recorded or empty is absent."""
    n = df.agg(F.count("*").alias("n_reports"))
    seen = df.select(F.explode(report).alias("field", "entry"))
    has = F.coalesce(~F.col("entry.value").isin("", NOT_RECORDED), F.lit(False))
    per = seen.groupBy("field").agg(F.count_if(has).alias("present"), F.array_join(F.sort_array(F.collect_set("entry.provenance")), ",").alias("tags"))
    names = df.sparkSession.createDataFrame([(k,) for k in FIELDS], "field string")
    out = names.join(per, "field", "left").join(n, F.lit(True))
    return out.select("field", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce(F.round(F.try_divide(F.coalesce("present", F.lit(0)) * 100.0, F.col("n_reports")), 1), F.lit(0.0)).alias("percent"), F.coalesce("tags", F.lit("")).alias("tags"))


def schema() -> dict:
    """JSON schema of a report."""
    entry = lambda tags: {"type": "object", "required": ["value", "provenance"], "properties": {"value": {}, "provenance": {"enum": sorted(tags)}}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": list(SCHEMA_REQUIRED), "additionalProperties": False, "properties": {k: entry(v) for k, v in FIELDS.items()}}


def write_schema(path: str) -> None:
    with open(path, "w") as f:
        json.dump(schema(), f, indent=2)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, v in FIELDS.items() for t in v], "field string, tag string")
