"""Sinks: tables as Parquet or CSV (partitioned where readers prune), one-row bundles as JSON."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Supplementary items.
ITEMS = ("S1", "S2", "S3", "S4", "S5", "S6")


def write_table(df: DataFrame, path: str, *, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", True).csv if kind == "csv" else getattr(writer, kind))(path)
    return path


def write_bundle(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> str:
    """A line of JSON a table: its name and its (few) rows."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.to_json(F.struct(F.lit(name).alias("name"), F.collect_list(F.struct(*df.columns)).alias("rows"))).alias("value"))
        out = row if out is None else out.unionByName(row)
    out.coalesce(1).write.mode(mode).text(path)
    return path


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file on any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def write_archives(predictions: DataFrame, folder: str) -> list[str]:
    """A compressed archive <setting>_seed<n>.npz a run, as :func:`tessera.sources.predictions.load_archives` reads them.

    Archives are packed by the cluster, a run a task (a test set is small), and come to the driver one at a time.
    """

    def pack(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("row_id", "ascending")])
        held = io.BytesIO()
        np.savez_compressed(held, probs=np.array(rows["probs"].to_pylist(), np.float32), y_true=rows["y_true"].to_numpy(), band=np.array(rows["band"].to_pylist(), str), group=rows["group"].to_numpy())
        name = f"{rows['setting'][0].as_py()}_seed{rows['seed'][0].as_py()}.npz"
        return pa.table({"name": pa.array([name]), "content": pa.array([held.getvalue()], pa.binary())})

    packed = predictions.select("setting", "seed", "row_id", "y_true", "band", "group", "probs").groupBy("setting", "seed").applyInArrow(pack, "name string, content binary")
    made = []
    for row in packed.toLocalIterator():
        write_bytes(predictions.sparkSession, f"{folder}/{row['name']}", row["content"])
        made.append(row["name"])
    return sorted(made)


def supplements(made: dict[str, DataFrame], folder: str) -> list[str]:
    """Write the supplements at hand and a README that lists all; return the items that are missing."""
    for item, df in made.items():
        write_table(df, f"{folder}/{item}", kind="csv")
    if made:
        lines = [f"* {item}: {'in this folder' if item in made else 'missing'}" for item in ITEMS]
        write_bytes(next(iter(made.values())).sparkSession, f"{folder}/README.md", ("# Supplements\n\n" + "\n".join(lines) + "\n").encode())
    return [i for i in ITEMS if i not in made]


def read_corpus(spark: SparkSession, path: str, split: str | None = "train", label: str = "target_class", kind: str = "parquet") -> DataFrame:
    """The corpus (Parquet, or CSV with a header), its training rows unless told otherwise, with the class column renamed."""
    df = spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else spark.read.parquet(path)
    if split and "split" in df.columns:
        df = df.filter(F.col("split") == split)
    return df.withColumnRenamed(label, "disease_label") if label in df.columns else df
