"""Ranking and classification metrics, by stratum, as aggregates over prediction rows.

Prediction rows: (run columns ..., row_id, y_true INT, band, group, probs ARRAY<DOUBLE>). ``by`` names the run columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(x: Column, parts: int = 256) -> Column:
    """A whole number that never falls as ``x`` grows: ``parts`` steps between each two powers of two, by size and sign."""
    size = F.abs(x)
    power = F.floor(F.log2(size))
    step = F.floor((power + 1100 + size / F.pow(F.lit(2.0), power) - 1) * parts) + 1
    step = F.when(size == 0, 0).when(size == float("inf"), 2100 * parts).otherwise(step)
    return F.when(F.isnan(x), 2101 * parts).when(x < 0, -step).otherwise(step).cast("long")


def binary_auroc(df: DataFrame, *, by: list[str], score: str, positive: str, weight: str | None = None) -> DataFrame:
    """(by, auroc): Mann-Whitney with half credit for ties; null if a class is missing.

    Rows are first combined per distinct score. Distinct scores are dealt to buckets that follow their order: what lies below
    a score is what its bucket has below it and what lower buckets hold. So one run's scores are spread over the cluster,
    and the last window sees a row a bucket.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    pos = F.col(positive).cast("boolean")
    rows = df.filter(F.col(score).isNotNull() & pos.isNotNull()).withColumn("_b", _bucket(F.col(score).cast("double")))
    per = rows.groupBy(*by, "_b", score).agg(F.sum(F.when(pos, w).otherwise(0.0)).alias("_p"), F.sum(F.when(pos, 0.0).otherwise(w)).alias("_n"))
    before = lambda n, keys, order: F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("_u", F.col("_p") * (before("_n", [*by, "_b"], score) + F.col("_n") / 2))
    per = per.groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in ("_u", "_p", "_n")])
    per = per.withColumn("_u", F.col("_u") + F.col("_p") * before("_n", by, "_b"))
    return per.groupBy(*by).agg(F.try_divide(F.sum("_u"), F.sum("_p") * F.sum("_n")).alias("auroc"))


def predicted(probs: Column) -> Column:
    """The first class of the greatest probability."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def common_classes(df: DataFrame, label: str = "y_true", stratum: str = "band", among: tuple[str, ...] = ("lighter", "darker")) -> DataFrame:
    """Classes present in every one of ``among``."""
    seen = df.filter(F.col(stratum).isin(*among)).groupBy(label).agg(F.count_distinct(stratum).alias("k"))
    return seen.filter(F.col("k") == len(among)).select(label)


def scores(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (row, class): positive flag and score, with the class id carried explicitly."""
    return df.select(*keep, "y_true", F.posexplode("probs").alias("class", "score")).withColumn("positive", F.col("y_true") == F.col("class"))


def macro_auroc(df: DataFrame, *, by: list[str], classes: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(by, auroc): mean of one-vs-rest AUROC over ``classes`` (default: those that occur), skipping undefined ones.

    Rows of other classes stay as negatives.
    """
    long = scores(df, [*by, *([weight] if weight else [])])
    wanted = classes if classes is not None else df.select(*by, "y_true").distinct()
    on = [c for c in wanted.columns if c in by]
    wanted = wanted.withColumnRenamed("y_true", "class")
    per = binary_auroc(long.join(wanted, [*on, "class"], "left_semi"), by=[*by, "class"], score="score", positive="positive", weight=weight)
    return per.groupBy(*by).agg(F.avg("auroc").alias("auroc"))


def class_table(df: DataFrame, *, by: list[str], labels: DataFrame | None = None) -> DataFrame:
    """(by, class, tp, fp, fn, support): rows whose class is in ``labels`` if given; other predictions count only as misses."""
    rows = df.withColumn("pred", predicted(F.col("probs"))).select(*by, "y_true", "pred")
    on = [c for c in labels.columns if c in by] if labels is not None else []
    if labels is not None:
        rows = rows.join(labels, [*on, "y_true"], "left_semi")
    counted = rows.groupBy(*by, "y_true", "pred").agg(F.count("*").alias("n"))
    truth = counted.groupBy(*by, F.col("y_true").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"), F.lit(0).cast("long").alias("guessed"))
    guess = counted.groupBy(*by, F.col("pred").alias("class")).agg(F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"), F.sum("n").alias("guessed"))
    both = truth.unionByName(guess).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "guessed")])
    if labels is not None:
        both = both.join(labels.withColumnRenamed("y_true", "class"), [*on, "class"], "left_semi")
    return both.select(*by, "class", "tp", (F.col("guessed") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "support")


def classification(df: DataFrame, *, by: list[str], labels: DataFrame | None = None) -> DataFrame:
    """(by, macro_f1, accuracy, balanced_accuracy). Macro-F1 over ``labels``, or over true and predicted classes; balanced accuracy over true ones."""
    table = class_table(df, by=by, labels=labels)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return table.groupBy(*by).agg(
        F.avg(f1).alias("macro_f1"), F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).alias("balanced_accuracy"),
    )


def stratum_metrics(df: DataFrame, *, by: list[str], classes: DataFrame) -> DataFrame:
    """Per band: macro AUROC and macro-F1 over the classes that both bands have."""
    resolved = df.filter(F.col("band").isin("lighter", "darker"))
    keys = [*by, "band"]
    return macro_auroc(resolved, by=keys, classes=classes).join(classification(resolved, by=keys, labels=classes).select(*keys, "macro_f1"), keys)


def fairness(per_stratum: DataFrame, *, by: list[str]) -> DataFrame:
    """delta = lighter - darker (positive: darker is worse off), abs_delta, worst group by AUROC (a tie goes to lighter), worst F1."""
    at = lambda b: F.max(F.when(F.col("band") == b, F.col("auroc")))
    order = F.when(F.col("auroc").isNotNull(), F.struct(F.col("auroc"), F.when(F.col("band") == "lighter", 0).otherwise(1)))
    aggs = [(at("lighter") - at("darker")).alias("delta"), F.min_by("band", order).alias("worst_group"), F.min("auroc").alias("worst_auroc"), F.min("macro_f1").alias("worst_f1")]
    out = (per_stratum.groupBy(*by) if by else per_stratum.groupBy()).agg(*aggs)
    return out.withColumn("abs_delta", F.abs("delta"))


def evaluate(df: DataFrame, *, by: list[str]) -> DataFrame:
    """All point metrics of every run."""
    classes = common_classes(df)
    whole = macro_auroc(df, by=by).join(classification(df, by=by), by)
    per = stratum_metrics(df, by=by, classes=classes)
    wide = [F.max(F.when(F.col("band") == b, F.col(m))).alias(f"{m}_{b}") for b in ("lighter", "darker") for m in ("auroc", "macro_f1")]
    return whole.join(per.groupBy(*by).agg(*wide), by).join(fairness(per, by=by), by)


def over_seeds(df: DataFrame, values: list[str], by: str = "setting") -> DataFrame:
    """Mean and sample deviation over seeds; the deviation of one seed is 0."""
    return df.groupBy(by).agg(*[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_sd"))])


# Groups of the external test.
EXTERNAL = ("I-II", "III-IV", "V-VI")


def external_gaps(df: DataFrame, *, by: list[str], group: str = "fst_group") -> DataFrame:
    """AUROC of each external group and of merged ones (on pooled rows), and three gaps. Classes are those of both extreme groups."""
    low, middle, high = EXTERNAL
    classes = common_classes(df, stratum=group, among=(low, high))
    g = F.col(group)
    tags = F.array_compact(F.array(g, F.when(g.isin(low, middle), f"{low}+{middle}"), F.when(g.isin(middle, high), f"{middle}+{high}")))
    per = macro_auroc(df.withColumn("tag", F.explode(tags)), by=[*by, "tag"], classes=classes)
    at = {t: F.max(F.when(F.col("tag") == t, F.col("auroc"))) for t in (low, middle, high, f"{low}+{middle}", f"{middle}+{high}")}
    gaps = [
        *[at[t].alias(n) for t, n in zip(EXTERNAL, ("auroc_low", "auroc_middle", "auroc_high"), strict=True)],
        (at[low] - at[high]).alias("gap_primary"), (at[f"{low}+{middle}"] - at[high]).alias("gap_middle_with_lighter"), (at[low] - at[f"{middle}+{high}"]).alias("gap_middle_with_darker"),
    ]
    return (per.groupBy(*by) if by else per.groupBy()).agg(*gaps)


def check_alignment(df: DataFrame, runs: list[str]) -> DataFrame:
    """Raise unless every run has the same label, band and group for each row id."""
    odd = df.groupBy("row_id").agg(F.count_distinct(F.struct("y_true", "band", "group")).alias("k")).filter("k > 1").limit(1)
    if not odd.isEmpty():
        raise ValueError("runs disagree on labels, bands or groups")
    return df


def logsumexp(x: Column) -> Column:
    """Of an array column."""
    top = F.array_max(x)
    return top + F.ln(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v))


def contrastive_loss(pairs: DataFrame, *, key: str = "id", image: str = "image", text: str = "text", batch: str = "batch", temperature: float = 0.07) -> DataFrame:
    """(batch, n, loss): symmetric InfoNCE loss of each batch of (image, text) vector pairs; pairs meet within their batch alone."""
    from tessera.operators.dedup import cosine

    left, right = pairs.select(batch, F.col(key).alias("i"), F.col(image).alias("vi")), pairs.select(batch, F.col(key).alias("j"), F.col(text).alias("vj"))
    sims = left.join(right, batch).select(batch, "i", "j", (cosine(F.col("vi"), F.col("vj")) / temperature).alias("s"))
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("s")))
    side = lambda k: sims.groupBy(batch, k).agg((logsumexp(F.collect_list("s")) - own).alias("l")).select(batch, "l")
    both = side("i").unionByName(side("j"))  # as many rows of each side
    return both.groupBy(batch).agg((F.count("*") / 2).cast("long").alias("n"), F.avg("l").alias("loss"))
