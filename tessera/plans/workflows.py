"""The workflows as functions: each returns DataFrames, gates raise before anything is written, and :func:`write` stores what one returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import bootstrap as B
from tessera.operators import captions, curve, dedup, labels, metrics, probe, records, reports, sampling, splits, tone
from tessera.session import cut
from tessera.sources import sinks


def audit(spark: SparkSession, path: str, *, floor: int = records.FLOOR, anchors=None, n_boot: int = 2000, seed: int = 2026, **columns) -> dict[str, DataFrame]:
    """Part I: clean, count, summarise, associate, fit the trend, project the gap at the adequate medians, vary the settings."""
    df = cut(records.load_metadata(spark, path, **columns))
    out = A.run_audit(df, floor)
    cover = out["coverage"].first()
    fit = curve.fit_curve(*zip(*(anchors or curve.ANCHORS), strict=True))
    adequate = (cover["median_adequate_lighter"], cover["median_adequate_darker"])
    if None not in adequate:
        out["gap"] = curve.project_gap(spark, fit, *adequate, n_boot, seed)
        every = (cover["median_all_lighter"], cover["median_all_darker"])
        settings = [("adequate medians", "exponential", *adequate), ("adequate medians", "power", *adequate), ("all medians", "exponential", *every)]
        out["sensitivity"] = curve.sensitivity(spark, anchors or curve.ANCHORS, settings, n_boot, seed)
    out["ratio_histogram"] = A.ratio_histogram(out["per_condition_counts"])
    return out


def build_corpus(manifest: DataFrame, label_map: DataFrame, *, fractions=(0.7, 0.1, 0.2), seed: int = 2026, shards: int = 1) -> dict[str, DataFrame]:
    """Part II: guard, map labels, drop excluded rows, band, group keys, split, leakage gate, reports and their gate."""
    labels.reject_source(manifest)
    labels.validate_label_map(label_map)
    rows = labels.apply_label_map(manifest, label_map).filter(~F.col("excluded"))
    if "band" not in rows.columns:
        source = records.band_or_uncertain(F.col("fitzpatrick_source"), dict(rows.dtypes)["fitzpatrick_source"] == "string") if "fitzpatrick_source" in rows.columns else F.lit(None).cast("string")
        angle = tone.classify(F.col("ita_value"))["band"] if "ita_value" in rows.columns else F.lit("uncertain")
        level = F.col("ita_confidence_level") if "ita_confidence_level" in rows.columns else F.lit("low")
        rows = rows.withColumn("band", tone.resolve(source, angle, level)["band"])
    rows = dedup.group_keys(rows)
    corpus = splits.verify_no_leakage(splits.stratified_group_split(rows, fractions=fractions, seed=seed, shards=shards))
    have = {name: F.col(c) for name, c in {"disease_label": "target_class", "analysis_band": "band", **{k: k for k in reports.FIELDS}}.items() if c in corpus.columns}
    have.setdefault("case_id", F.col("group_key"))
    reported = reports.build_report(corpus, have)
    reported = reported.withColumn("report", F.map_concat(F.map_filter("report", lambda k, v: k != "caption_template"), F.create_map(F.lit("caption_template"), reports.field(captions.template_caption(F.col("report")), "C"))))
    reports.validate(reported)
    return {"corpus": corpus, "reports": reported, "splits": splits.split_summary(corpus), "coverage": reports.coverage(reported), "label_map": labels.label_map_summary(label_map)}


def sample_ablations(pool: DataFrame, n_per_class: int, *, settings=None, seed: int = 2026, **columns) -> dict[str, DataFrame]:
    """Training rows of each rung; a size above the feasible one is refused, a rung that is short is left out."""
    feasible = sampling.max_feasible_n(pool, **{k: v for k, v in columns.items() if k != "row_id"}).first()["max_n"]
    if not n_per_class or n_per_class > feasible:
        raise ValueError(f"a size per class from 1 to {feasible} is needed")
    out = {}
    for name in settings or sampling.LADDER:
        try:
            out[name] = sampling.build_ablation(name, pool, n_per_class, seed, **columns)
        except ValueError:
            continue
    return out


def evaluate(predictions: DataFrame, *, n_boot: int = 2000, seed: int = 2026) -> dict[str, DataFrame]:
    """Point metrics over seeds, bootstrap intervals of the gap, paired tests of the ladder's comparisons with Holm's adjustment."""
    spark = predictions.sparkSession
    by = ["setting", "seed"]
    predictions = cut(predictions)  # archives are read once
    point = metrics.evaluate(metrics.check_alignment(predictions, by), by=by)
    values = ["auroc", "macro_f1", "accuracy", "balanced_accuracy", "auroc_lighter", "auroc_darker", "delta", "abs_delta", "worst_auroc", "worst_f1"]
    weights = B.group_weights(predictions, n_boot, seed)
    raw = B.delta_replicates(predictions, weights, by=by, classes=metrics.common_classes(predictions))
    raw = cut(raw)
    reps = B.mean_over_seeds(raw, drop_missing=False)
    tests = None
    for r in sampling.available_comparisons(spark, predictions.select("setting").distinct()).orderBy("treatment").collect():
        row = B.paired_test(reps, r["treatment"], r["comparator"])
        tests = row if tests is None else tests.unionByName(row)
    out = {"metrics": point, "table": metrics.over_seeds(point, values), "intervals": B.interval(B.mean_over_seeds(raw, drop_missing=True))}
    if tests is not None:
        out["comparisons"] = B.holm(tests, order="treatment")
    return out


def external_test(predictions: DataFrame) -> DataFrame:
    per = metrics.external_gaps(predictions.withColumnRenamed("band", "fst_group") if "fst_group" not in predictions.columns else predictions, by=["setting", "seed"])
    return metrics.over_seeds(per, [c for c in per.columns if c.startswith(("auroc", "gap"))])


def image_text(features: DataFrame, *, max_iter: int = 100) -> DataFrame:
    """(variant, metrics): a linear probe of each caption variant's features (as from ``load_feature_archives``), fitted on ``train``, judged on ``test``."""
    out = None
    for variant in [r["variant"] for r in features.select("variant").distinct().orderBy("variant").collect()]:  # a few variants
        mine = features.filter(F.col("variant") == variant)
        test = mine.filter("part = 'test'")
        judged = probe.linear_probe(mine.filter("part = 'train'"), test, max_iter=max_iter)
        judged = judged.select(F.lit(variant).alias("variant"), "row_id", F.col("label").alias("y_true"), "band", "probs")
        row = metrics.evaluate(judged, by=["variant"])
        out = row if out is None else out.unionByName(row)
    return out


#: Where a workflow's tables go: name -> (path, kind, partition columns); what is not named here is a Parquet table of its own name.
PLACES = {
    "representation": ("representation", "csv", ()), "per_condition_counts": ("per_condition_counts", "csv", ()),
    "corpus": ("corpus", "parquet", ("split",)), "splits": ("split_summary", "csv", ()), "label_map": ("supplement_label_map", "csv", ()), "coverage": ("supplement_field_coverage", "json", ()),
    "table": ("metrics", "csv", ()), "comparisons": ("ablation_comparisons", "csv", ()), "external": ("external_test", "json", ()), "image_text": ("image_text", "json", ()),
}


def write(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Store the tables of a workflow under ``folder``; returns their paths. Small result tables also go to one ``results`` bundle."""
    made = []
    for name, df in tables.items():
        place, kind, parts = PLACES.get(name, (name, "parquet", ()))
        flat = df if kind != "csv" else df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        made.append(sinks.write_table(flat, f"{folder}/{place}", kind=kind, partition_by=tuple(p for p in parts if p in df.columns)))
    small = {k: v for k, v in tables.items() if k in ("association", "trend", "gap", "table", "comparisons", "intervals", "external", "image_text")}
    if small:
        made.append(sinks.write_bundle(small, f"{folder}/results"))
    return made


def write_ablations(rungs: dict[str, DataFrame], folder: str, n_per_class: int) -> list[str]:
    """Training rows of each rung in one table by setting, and a manifest: composition, size, presets and seeds of each."""
    made, manifest = [], None
    for name, rows in rungs.items():
        made.append(sinks.write_table(rows.drop("setting"), f"{folder}/train/setting={name}"))
        row = sampling.composition(rows).withColumn("setting", F.lit(name))
        manifest = row if manifest is None else manifest.unionByName(row)
    if manifest is not None:
        settings = sampling.ladder(manifest.sparkSession).withColumnRenamed("name", "setting").select("setting", "title", "colour_constancy", "tone_weighted_loss")
        manifest = manifest.join(settings, "setting").withColumns({"n_per_class": F.lit(n_per_class), "seeds": F.array(*[F.lit(s) for s in sampling.SEEDS])})
        made.append(sinks.write_table(manifest, f"{folder}/ablation_manifest", kind="json"))
    return made
