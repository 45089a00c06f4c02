"""Audit of representation: counts, coverage, association, trend. Input: cleaned records."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import chi2_tail, half_even, t_quantile, t_two_sided
from tessera.operators.records import FLOOR

BANDS = ("lighter", "darker")


def of_band(name: str) -> Column:
    return F.col("band") == name


def representation(df: DataFrame, scale: str = "fitzpatrick", levels: tuple[int, int] = (1, 6)) -> DataFrame:
    """Rows and percent per level, zero-filled."""
    low, high = levels
    all_levels = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(scale))
    counted = df.groupBy(scale).agg(F.count("*").alias("n"))
    filled = all_levels.join(counted, scale, "left").select(scale, F.coalesce("n", F.lit(0)).alias("n"))  # a row a level
    share = F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy()))
    return filled.withColumn("percent", half_even(share, 2))


def band_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("band").agg(F.count("*").alias("n"))


def per_condition_counts(df: DataFrame, condition: str = "condition") -> DataFrame:
    """condition, lighter, darker, ratio (null if there is no darker row); one shuffle, no pivot."""
    counts = [F.count_if(of_band(b)).alias(b) for b in BANDS]
    return df.groupBy(condition).agg(*counts).withColumn("ratio", F.try_divide(F.col("lighter").cast("double"), F.col("darker")))


def coverage_summary(counts: DataFrame, floor: int = FLOOR) -> DataFrame:
    """One row: how many conditions each band covers adequately, medians over all and over adequate ones, ratios.

    A band's adequate median filters on its own counts. Ratio figures take conditions that both bands have.
    """
    both = (F.col("lighter") > 0) & (F.col("darker") > 0)
    total = F.count("*")
    exprs = [total.alias("n_conditions")]
    for b in BANDS:
        ok = F.col(b) >= floor
        exprs += [
            F.count_if(ok).alias(f"adequate_{b}"), half_even(F.try_divide(F.count_if(ok) * 100.0, total), 1).alias(f"adequate_percent_{b}"),
            F.median(b).alias(f"median_all_{b}"), F.median(F.when(ok, F.col(b))).alias(f"median_adequate_{b}"),
        ]
    ratio = F.when(both, F.col("ratio"))
    exprs += [
        F.median(ratio).alias("median_ratio"), F.percentile(ratio, 0.25).alias("ratio_q1"), F.percentile(ratio, 0.75).alias("ratio_q3"),
        half_even(F.try_divide(F.count_if(both & (F.col("lighter") > F.col("darker"))) * 100.0, F.count_if(both)), 1).alias("percent_more_lighter"),
    ]
    return counts.agg(*exprs)


def contingency(df: DataFrame, row: str = "band", column: str = "category") -> DataFrame:
    return df.groupBy(row, column).agg(F.count("*").alias("n"))


def category_association(df: DataFrame, row: str = "band", column: str = "category") -> DataFrame:
    """One row: chi2, dof, p, n, cramers_v of observed levels; Yates' correction if dof is 1. More than ``MOST_LEVELS`` levels are an error."""
    table = contingency(df, row, column)
    rows, columns = table.groupBy(row).agg(F.sum("n").alias("r")), table.groupBy(column).agg(F.sum("n").alias("c"))
    for name, levels in ((row, rows), (column, columns)):
        if levels.limit(MOST_LEVELS + 1).count() > MOST_LEVELS:
            raise ValueError(f"{name} has more than {MOST_LEVELS} levels and is no classification")
    # Observed levels of two classifying columns: a table of a few cells, zero-filled.
    cells = rows.join(columns, F.lit(True)).join(table, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = Window.partitionBy()
    cells = cells.withColumn("total", F.sum("n").over(whole)).withColumn("expected", F.col("r") * F.col("c") / F.col("total"))
    size = cells.agg(F.count_distinct(row).alias("nr"), F.count_distinct(column).alias("nc"))
    cells = cells.join(size, F.lit(True)).withColumn("dof", (F.col("nr") - 1) * (F.col("nc") - 1))
    gap = F.abs(F.col("n") - F.col("expected"))
    gap = F.when(F.col("dof") == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
    out = cells.groupBy("dof", "nr", "nc", "total").agg(F.sum(gap * gap / F.col("expected")).alias("chi2"))
    narrow = F.least("nr", "nc") - 1
    return out.select("chi2", "dof", _chi2_p(F.col("chi2"), F.col("dof")).alias("p"), F.col("total").alias("n"), F.sqrt(F.try_divide(F.col("chi2"), F.col("total") * narrow)).alias("cramers_v"))


#: Levels of a classifying column, at most.
MOST_LEVELS = 1_000


def _chi2_p(chi2: Column, dof: Column) -> Column:
    """P(chi-square > chi2) of a few rows; 1 without degrees of freedom."""

    @F.arrow_udf("double")
    def tail(x: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array([None if a is None else chi2_tail(a, b) if b else 1.0 for a, b in zip(x.to_pylist(), k.to_pylist(), strict=True)], pa.float64())

    return tail(chi2, dof)


def shares(df: DataFrame, positive: str = "malignant", scale: str = "fitzpatrick") -> DataFrame:
    return df.groupBy(scale).agg((F.avg((F.col("category") == positive).cast("double")) * 100).alias("share"))


def malignant_trend(df: DataFrame, positive: str = "malignant", scale: str = "fitzpatrick") -> DataFrame:
    """One row: slope, intercept, r, stderr, k of the least-squares line of share (percent) on level; 95 % t interval (low, high) and p of the slope."""
    points = shares(df, positive, scale).filter(F.col("share").isNotNull()).withColumn("x", F.col(scale).cast("double"))
    fit = points.agg(
        F.regr_slope("share", "x").alias("slope"), F.regr_intercept("share", "x").alias("intercept"), F.corr("share", "x").alias("r"),
        F.regr_sxx("share", "x").alias("sxx"), F.regr_syy("share", "x").alias("syy"), F.count("*").alias("k"),
    )
    stderr = F.sqrt(F.try_divide((1 - F.col("r") * F.col("r")) * F.col("syy"), F.col("sxx") * (F.col("k") - 2)))

    @F.arrow_udf("struct<low:double,high:double,p:double>")
    def interval(slope: pa.Array, error: pa.Array, k: pa.Array) -> pa.Array:
        rows = [trend_interval({"slope": a, "stderr": b, "k": c}) for a, b, c in zip(slope.to_pylist(), error.to_pylist(), k.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[c] for r in rows], pa.float64(), from_pandas=True) for c in ("low", "high", "p")], names=["low", "high", "p"])

    fit = fit.select("slope", "intercept", "r", stderr.alias("stderr"), "k")
    return fit.withColumn("of", interval("slope", "stderr", "k")).select("slope", "intercept", "r", "stderr", "k", "of.low", "of.high", "of.p")


def trend_interval(row, level: float = 0.95) -> dict[str, float]:
    """t interval and p of a row of :func:`malignant_trend`."""
    dof = row["k"] - 2
    if dof < 1 or row["stderr"] is None:
        return {"low": math.nan, "high": math.nan, "p": math.nan}
    half = t_quantile(0.5 + level / 2, dof) * row["stderr"]
    p = t_two_sided(row["slope"] / row["stderr"], dof) if row["stderr"] else 0.0
    return {"low": row["slope"] - half, "high": row["slope"] + half, "p": p}


def run_audit(df: DataFrame, floor: int = FLOOR, positive: str = "malignant") -> dict[str, DataFrame]:
    """All parts of the audit of cleaned records; the records are read once if the caller persists them."""
    counts = per_condition_counts(df)
    out = {"representation": representation(df), "band_counts": band_counts(df), "per_condition_counts": counts, "coverage": coverage_summary(counts, floor)}
    if "category" in df.columns:
        out |= {"association": category_association(df), "trend": malignant_trend(df, positive)}
    return out


def ratio_histogram(counts: DataFrame, bins: int = 28, top: float = 10.0) -> DataFrame:
    """(bin, n) of ratios clipped to [0, top]; bins span the data, the last one is closed."""
    r = counts.filter((F.col("lighter") > 0) & (F.col("darker") > 0)).select(F.least(F.greatest("ratio", F.lit(0.0)), F.lit(top)).alias("r"))
    edges = r.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    place = F.least(F.floor(F.try_divide((F.col("r") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    return r.join(F.broadcast(edges), F.lit(True)).groupBy(F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def trend_band(row, xs: list[float], mean_x: float, sxx: float, level: float = 0.95) -> list[tuple[float, float, float, float]]:
    """Figure data: (x, fit, low, high) of the trend line about the centroid."""
    width = t_quantile(0.5 + level / 2, max(row["k"] - 2, 1)) * row["stderr"]
    return [(x, y := row["intercept"] + row["slope"] * x, y - h, y + h) for x in xs for h in [width * math.sqrt(sxx / row["k"] + (x - mean_x) ** 2)]]
