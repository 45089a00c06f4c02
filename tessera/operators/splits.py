"""Leakage-free grouped, stratified three-way split, and its checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.portable import uniform_key

SPLITS = ("train", "validation", "test")


def _first_fold(counts: np.ndarray, folds: int) -> np.ndarray:
    """Groups (rows of stratum counts, in dealing order) of the first of ``folds`` folds, dealt greedily.

    Groups with the most uneven strata go first; each goes where the spread of the strata's shares over the folds grows least.
    """
    order = np.argsort(-counts.std(axis=1), kind="stable")
    total = np.maximum(counts.sum(axis=0), 1)
    held, sizes, mine = np.zeros((folds, counts.shape[1])), np.zeros(folds), np.zeros(len(counts), bool)
    for g in order:
        share, add = held / total, counts[g] / total
        sums, squares = share.sum(axis=0), (share**2).sum(axis=0)
        spread = (squares - share**2 + (share + add) ** 2) / folds - ((sums + add) / folds) ** 2
        cost = np.sqrt(np.maximum(spread, 0)).mean(axis=1)
        best = np.flatnonzero(cost <= cost.min() + 1e-12)
        k = best[np.argmin(sizes[best])]
        held[k] += counts[g]
        sizes[k] += counts[g].sum()
        mine[g] = k == 0
    return mine


#: Groups that one shard may have.
MOST_GROUPS = 200_000


def folds(fractions: tuple[float, float, float]) -> tuple[int, int]:
    """(folds of which one is the test set, folds of the rest of which one is the validation set)."""
    if len(fractions) != 3 or min(fractions) <= 0 or abs(sum(fractions) - 1) > 1e-9:
        raise ValueError(f"three positive fractions that sum to 1 are needed, not {fractions}")
    train, validation, test = fractions
    found = round(1 / test), round((train + validation) / validation)
    if min(found) < 2:
        raise ValueError(f"fractions {fractions} leave fewer than two folds")
    return found


def stratified_group_split(df: DataFrame, *, label: str = "target_class", band: str = "band", group: str = "group_key", fractions=(0.7, 0.1, 0.2), seed: int = 2026, shards: int = 1) -> DataFrame:
    """``df`` with a ``split`` column; every group lies in one split and every row is kept.

    Groups are dealt out to ``shards`` by hash and each shard is split by itself (greedily, with its own strata), so the
    work is spread over the cluster. A task holds a count for each group and stratum of a shard, and shards of a few groups are
    dealt unevenly: choose ``shards`` for thousands of groups each; a shard of more than ``MOST_GROUPS`` is an error. A row without a group is an
    error; a null label or band is a stratum of its own.
    """
    outer, inner = folds(tuple(fractions))
    if not df.filter(F.col(group).isNull()).isEmpty():
        raise ValueError(f"rows without a {group}")
    strata = df.groupBy(F.col(group).alias("group"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"), F.coalesce(F.col(band).cast("string"), F.lit("")).alias("band")).agg(F.count("*").alias("n"))
    strata = strata.withColumn("shard", F.pmod(F.xxhash64("group"), F.lit(shards))).withColumn("order", uniform_key(seed, F.col("group")))
    if (most := strata.groupBy("shard").agg(F.approx_count_distinct("group").alias("k")).agg(F.max("k")).first()[0] or 0) > MOST_GROUPS:
        raise ValueError(f"a shard of about {most} groups; take more than {shards} shards")

    def deal(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("order", "ascending")])
        of = rows["order"].combine_chunks().dictionary_encode()
        groups, first = np.unique(of.indices.to_numpy(), return_index=True)
        kinds = pc.binary_join_element_wise(rows["label"], rows["band"], "\u0001").combine_chunks().dictionary_encode()
        counts = np.zeros((len(groups), len(kinds.dictionary)))
        np.add.at(counts, (of.indices.to_numpy(), kinds.indices.to_numpy()), rows["n"].to_numpy())
        out = np.full(len(groups), "train", dtype=object)
        in_test = _first_fold(counts, outer)
        out[in_test] = "test"
        rest = np.flatnonzero(~in_test)
        out[rest[_first_fold(counts[rest][::-1], inner)[::-1]]] = "validation"
        return pa.table({group: rows["group"].take(pa.array(first)), "split": pa.array(out, pa.string())})

    assigned = strata.groupBy("shard").applyInArrow(deal, f"`{group}` {dict(df.dtypes)[group]}, split string")
    return df.join(assigned, group)


def leaking_groups(df: DataFrame, group: str = "group_key", split: str = "split", limit: int = 50) -> DataFrame:
    """Groups in more than one split (a report of at most ``limit``)."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1").orderBy(group).limit(limit)


def verify_no_leakage(df: DataFrame, group: str = "group_key", split: str = "split") -> DataFrame:
    found = [r[0] for r in leaking_groups(df, group, split).collect()]
    if found:
        raise ValueError(f"groups in several splits: {found[:5]}")
    return df


def split_summary(df: DataFrame, *, label: str = "target_class", band: str = "band", group: str = "group_key") -> DataFrame:
    """Per split and in total: images, groups, bands, classes, percent darker of resolved rows. Total groups are summed, classes distinct overall."""
    named = lambda b: F.count_if(F.col(band) == b)
    share = F.round(F.try_divide(named("darker") * 100.0, named("darker") + named("lighter")), 1)
    parts = [F.count("*").alias("images"), F.count_distinct(group).alias("groups"), *[named(b).alias(b) for b in ("lighter", "darker", "uncertain")], F.count_distinct(label).alias("classes"), share.alias("darker_percent")]
    per = df.groupBy("split").agg(*parts)
    groups = df.groupBy("split").agg(F.count_distinct(group).alias("g")).agg(F.sum("g").alias("groups"))
    total = df.agg(*[p for i, p in enumerate(parts) if i != 1]).join(groups, F.lit(True)).select(F.lit("total").alias("split"), *per.columns[1:])
    return per.unionByName(total)


def supplement_counts(df: DataFrame, *, dataset: str = "source_dataset", label: str = "target_class", band: str = "band") -> DataFrame:
    keys = ["split", dataset, label, band]
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))
