"""Stratified group bootstrap: whole groups drawn with replacement within each band.

A draw depends on (seed, replicate, band, slot) alone, so all settings share the same draws: that is the pairing.
Replicates are weights per group, not copies of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.portable import uniform_int
from tessera.operators.metrics import macro_auroc, scores


def group_weights(df: DataFrame, n_boot: int, seed: int = 2026, *, band: str = "band", group: str = "group") -> DataFrame:
    """(rep, band, group, w): how often a group is drawn; groups are (band, group) pairs and every band value is a stratum."""
    groups = df.select(F.col(band).alias("band"), F.col(group).alias("group")).distinct()
    place = Window.partitionBy("band")
    groups = groups.withColumn("slot", F.row_number().over(place.orderBy("group")) - 1).withColumn("size", F.count("*").over(place))
    reps = df.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("rep"))
    draws = groups.select("band", "slot", "size").join(reps, F.lit(True))  # n_boot rows a group, as the design asks
    draws = draws.select("rep", "band", uniform_int(F.col("size"), seed, F.col("rep"), F.col("band"), F.col("slot")).alias("slot"))
    counted = draws.groupBy("rep", "band", "slot").agg(F.count("*").alias("w"))
    return counted.join(groups.select("band", "slot", "group"), ["band", "slot"]).select("rep", "band", "group", "w")


#: Weights (groups x replicates) that are broadcast, and rows of one run that a task may hold, at most.
MOST_WEIGHTS, MOST_ROWS = 100_000_000, 5_000_000


def delta_replicates(df: DataFrame, weights: DataFrame, *, by: list[str], classes: DataFrame, most_weights: int = MOST_WEIGHTS, most_rows: int = MOST_ROWS) -> DataFrame:
    """(by, rep, delta): weighted macro-AUROC gap of each replicate.

    Test sets are small beside their replicates. While the counted weights and the largest run are within ``most_weights``
    and ``most_rows``, rows are dealt out by (run, band, class), sorted by score once, and all replicates are weighed as vectors;
    no row is copied for a replicate. Larger sets take the same sums in SQL, a row a replicate.
    """
    rows = df.filter(F.col("band").isin("lighter", "darker"))
    size = weights.agg(F.count_distinct("band", "group").alias("g"), F.count_distinct("rep").alias("r")).first()
    largest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if size["g"] * size["r"] <= most_weights and largest <= most_rows:
        per = _weighed(rows, weights, by, classes)
    else:
        rows = rows.join(weights, ["band", "group"])
        per = macro_auroc(rows.withColumn("w", F.col("w").cast("double")), by=[*by, "rep", "band"], classes=classes, weight="w")
    at = lambda b: F.max(F.when(F.col("band") == b, F.col("auroc")))
    return per.groupBy(*by, "rep").agg((at("lighter") - at("darker")).alias("delta"))


def _weighed(rows: DataFrame, weights: DataFrame, by: list[str], classes: DataFrame, block: int = 64) -> DataFrame:
    """(by, band, rep, auroc), the mean over classes; weights are broadcast as a matrix of small numbers."""
    spark = rows.sparkSession
    drawn = weights.filter(F.col("band").isin("lighter", "darker")).groupBy("band", "group").agg(F.collect_list(F.struct("rep", "w")).alias("draws")).toPandas()  # within most_weights
    reps = np.array(sorted({r for x in drawn["draws"] for r, _ in x}), np.int64)
    matrix = np.zeros((len(drawn), len(reps)), np.uint16)
    for i, draws in enumerate(drawn["draws"]):
        r, w = np.array(draws, np.int64).reshape(-1, 2).T
        matrix[i, np.searchsorted(reps, r)] = w
    shared = spark.sparkContext.broadcast((dict(zip(zip(drawn["band"], drawn["group"], strict=True), range(len(drawn)), strict=True)), reps, matrix))
    long = scores(rows, [*by, "band", "group"]).join(classes.withColumnRenamed("y_true", "class"), "class", "left_semi").filter(F.col("score").isNotNull())
    keys = [*by, "band", "class"]
    kinds = dict(long.dtypes)

    def weigh(key: tuple, table: pa.Table) -> pa.Table:
        places, reps, matrix = shared.value
        band = key[len(by)].as_py()
        group, score, positive = table["group"].to_pylist(), table["score"].to_numpy(), table["positive"].to_numpy()
        at = np.array([places.get((band, g), -1) for g in group])
        known = at >= 0
        at, score, positive = at[known], score[known], positive[known]
        value = np.concatenate([weighted_auroc(positive, score, matrix[at, low : low + block].T.astype(float)) for low in range(0, len(reps), block)]) if len(at) else np.full(len(reps), np.nan)
        out = {k: pa.array([v.as_py()] * len(reps), v.type) for k, v in zip(keys, key, strict=True)}
        return pa.table(out | {"rep": pa.array(reps, pa.int32()), "auroc": pa.array(value, pa.float64(), from_pandas=True)})

    found = long.groupBy(*keys).applyInArrow(weigh, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", rep int, auroc double")
    return found.groupBy(*by, "band", "rep").agg(F.avg("auroc").alias("auroc"))


def mean_over_seeds(reps: DataFrame, *, drop_missing: bool) -> DataFrame:
    """(setting, rep, delta). A missing seed is dropped, or (paired tests) makes the replicate missing."""
    out = reps.groupBy("setting", "rep").agg(F.avg("delta").alias("delta"), F.count_if(F.col("delta").isNull()).alias("_missing"))
    return out.select("setting", "rep", (F.col("delta") if drop_missing else F.when(F.col("_missing") == 0, F.col("delta"))).alias("delta")).filter(F.col("delta").isNotNull())


def interval(reps: DataFrame, value: str = "delta", level: float = 0.95, by: str = "setting") -> DataFrame:
    tail = (1 - level) / 2
    return reps.groupBy(by).agg(F.percentile(value, tail).alias("low"), F.percentile(value, 1 - tail).alias("high"), F.count(value).alias("n_ok"))


def paired_test(reps: DataFrame, treatment: str, comparator: str, level: float = 0.95) -> DataFrame:
    """One row: mean difference treatment - comparator on shared replicates, its interval and two-sided p (ties at 0 count in both tails)."""
    a = reps.filter(F.col("setting") == treatment).select("rep", F.col("delta").alias("t"))
    b = reps.filter(F.col("setting") == comparator).select("rep", F.col("delta").alias("c"))
    diff = a.join(b, "rep").select((F.col("t") - F.col("c")).alias("d"))
    tail = (1 - level) / 2
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))))
    return diff.agg(F.avg("d").alias("diff"), F.percentile("d", tail).alias("low"), F.percentile("d", 1 - tail).alias("high"), p.alias("p"), F.count("*").alias("n_ok")).select(F.lit(treatment).alias("treatment"), F.lit(comparator).alias("comparator"), "*")


def holm(df: DataFrame, p: str = "p", order: str = "ordinal") -> DataFrame:
    """``df`` with ``p_holm``: step-down, running maximum, at most 1. Missing p sort last and inherit the maximum."""
    w = Window.orderBy(F.col(p).asc_nulls_last(), F.col(order))  # one row a comparison
    m = F.count("*").over(Window.partitionBy())
    stepped = df.withColumn("_step", (m - F.row_number().over(w) + 1) * F.col(p))
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def weighted_auroc(positive: np.ndarray, scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """AUROC of every replicate (rows of ``weights``) at once; the scores are sorted one time."""
    order = np.argsort(scores, kind="stable")
    s, pos, w = scores[order], positive[order], weights[:, order]
    edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    p, n = np.add.reduceat(w * pos, edges, axis=1), np.add.reduceat(w * ~pos, edges, axis=1)
    below = np.cumsum(n, axis=1) - n
    with np.errstate(invalid="ignore", divide="ignore"):
        return (p * (below + n / 2)).sum(axis=1) / (p.sum(axis=1) * n.sum(axis=1))


def collected(rows: DataFrame, most: int = MOST_ROWS) -> pd.DataFrame:
    """A test set for :func:`bootstrap_metric` (some hundred MB at most), counted first; a larger one is an error, never cut. It belongs to :func:`delta_replicates`."""
    if (n := rows.count()) > most:
        raise ValueError(f"{n} rows are more than the {most} that are broadcast; use delta_replicates")
    return rows.toPandas()


#: Cells (replicates x rows) of one block of weights.
_CELLS = 20_000_000


def bootstrap_metric(spark: SparkSession, rows: pd.DataFrame, metric, n_boot: int = 2000, seed: int = 2026) -> DataFrame:
    """(rep, value) of any metric of one test set (which fits a worker): blocks of replicates are dealt out over the cluster.

    ``metric(rows, weights)`` gets the rows and a (replicates x rows) matrix of multiplicities and returns a value a replicate.
    """
    shared = spark.sparkContext.broadcast(rows)
    block = max(1, min(50, _CELLS // max(1, len(rows))))  # a task holds a bounded matrix of weights

    def run(batches):
        table = shared.value
        strata = [(np.flatnonzero(table["band"].to_numpy() == b), pd.factorize(table.loc[table["band"] == b, "group"], sort=True)) for b in sorted(table["band"].unique())]
        for pdf in batches:
            for at in range(0, len(pdf), block):
                reps = pdf["id"].to_numpy()[at : at + block]
                weights = np.zeros((len(reps), len(table)))
                for i, rep in enumerate(reps):
                    rng = np.random.default_rng([seed, int(rep)])
                    for index, (codes, names) in strata:
                        weights[i, index] = np.bincount(rng.integers(0, len(names), len(names)), minlength=len(names))[codes]
                yield pd.DataFrame({"rep": reps, "value": metric(table, weights)})

    return spark.range(n_boot).mapInPandas(run, "rep long, value double")
