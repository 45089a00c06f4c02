"""Duplicates: file hashes, perceptual hashes, pair search, clusters, group keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.session import cut


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def exact_duplicates(df: DataFrame, content: Column, key: str) -> DataFrame:
    """(key, sha256, first_key, is_duplicate): rows that repeat an earlier row's content; hot contents are combined before the shuffle."""
    hashed = df.select(key, F.sha2(content.cast("binary"), 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min(key).alias("first_key"))
    return hashed.join(first, "sha256").withColumn("is_duplicate", F.col(key) > F.col("first_key"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def dhash(grid: Column, size: int = 8) -> Column:
    """64-bit difference hash of a (size x (size + 1)) luminance grid, row by row: bit 1 where the right neighbour is brighter, first bit highest."""
    bits = [F.when(F.get(grid, F.lit(r * (size + 1) + c + 1)) > F.get(grid, F.lit(r * (size + 1) + c)), F.shiftleft(F.lit(1).cast("long"), size * size - 1 - r * size - c)).otherwise(F.lit(0).cast("long")) for r in range(size) for c in range(size)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _resampling(size: int, out: int) -> np.ndarray:
    """(out x size) weights that reduce or enlarge a line of ``size`` samples by cubic convolution, widened where it shrinks."""
    scale = size / out
    wide = max(scale, 1.0)
    x = np.abs((np.arange(size)[None, :] + 0.5 - (np.arange(out)[:, None] + 0.5) * scale) / wide)
    near, far = (1.5 * x - 2.5) * x * x + 1, ((-0.5 * x + 2.5) * x - 4) * x + 2
    weights = np.where(x < 1, near, np.where(x < 2, far, 0.0))
    return weights / weights.sum(axis=1, keepdims=True)


def grey_grid(image: np.ndarray, size: int = 8) -> np.ndarray:
    """(size x (size + 1)) luminance of an image (height x width x 3, 0 to 255): grey first, then lines, then columns, rounded to whole levels each time."""
    grey = np.rint(image.astype(float) @ np.array([0.299, 0.587, 0.114]))
    level = lambda x: np.clip(np.rint(x), 0, 255)
    return level(_resampling(grey.shape[0], size) @ level(grey @ _resampling(grey.shape[1], size + 1).T))


def image_hash(width: Column, height: Column, rgb: Column, size: int = 8) -> Column:
    """Difference hash of images given as rows of red, green and blue bytes; null where the bytes don't fit width and height."""

    @F.arrow_udf("array<int>")
    def grid(w: pa.Array, h: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for a, b, c in zip(w.to_pylist(), h.to_pylist(), data.to_pylist(), strict=True):
            fits = a and b and c is not None and len(c) == 3 * a * b
            out.append(grey_grid(np.frombuffer(c, np.uint8).reshape(b, a, 3), size).astype(int).ravel().tolist() if fits else None)
        return pa.array(out, pa.list_(pa.int32()))

    found = grid(width, height, rgb)
    return F.transform(F.array(found), lambda g: F.when(g.isNotNull(), dhash(g, size)))[0]


def hash_classes(df: DataFrame, *, key: str, value: str) -> DataFrame:
    """(value, rep, n): rows of equal ``value`` are one class, named by its least key; combined before the shuffle. Null values have no class."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(key).alias("rep"), F.count("*").alias("n"))


def _met(rows: DataFrame, most: int, bits: int) -> DataFrame:
    """Pairs of ``rows`` (item STRUCT, value) within ``most`` bits, each once: (x, y) with x before y.

    Two values within ``most`` bits agree on at least one of ``most + 1`` blocks of bits, so they meet in an equi-join of
    blocks; the first block on which they agree is the one that reports them.
    """
    edges = [bits * i // (most + 1) for i in range(most + 2)]
    spans = list(zip(edges, edges[1:], strict=False))
    cut_out = lambda v, low, high: F.shiftrightunsigned(v, low).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 64 else -1).cast("long"))
    blocks = F.array(*[F.struct(F.lit(i).alias("i"), cut_out(F.col("value"), *span).alias("v")) for i, span in enumerate(spans)])
    side = rows.select(F.struct("item", "value").alias("of"), F.explode(blocks).alias("block"))
    x, y = F.col("x.value"), F.col("y.value")
    first = F.coalesce(*[F.when(cut_out(x.bitwiseXOR(y), *span) == 0, F.lit(i)) for i, span in enumerate(spans)])
    pairs = side.withColumnRenamed("of", "x").join(side.withColumnRenamed("of", "y"), "block")
    return pairs.filter((F.col("x.item") < F.col("y.item")) & (hamming(x, y) <= most) & (first == F.col("block.i"))).select("x", "y")


def hamming_links(classes: DataFrame, *, most: int, bits: int = 64) -> DataFrame:
    """(a, b, distance, n_a, n_b): all pairs of different classes within ``most`` bits, a before b. ``classes`` as from :func:`hash_classes`."""
    met = _met(classes.select(F.struct("rep", "n").alias("item"), "value"), most, bits)
    return met.select(F.col("x.item.rep").alias("a"), F.col("y.item.rep").alias("b"), hamming(F.col("x.value"), F.col("y.value")).alias("distance"), F.col("x.item.n").alias("n_a"), F.col("y.item.n").alias("n_b"))


def _counted(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, class, n_links) of ``members`` (key, class, n): the other rows of the class and all rows of linked ones."""
    near = links.select(F.col("a").alias("class"), F.col("n_b").alias("m")).unionByName(links.select(F.col("b").alias("class"), F.col("n_a").alias("m")))
    near = near.groupBy("class").agg(F.sum("m").alias("m"))
    return members.join(near, "class", "left").select(key, "class", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))


def hash_links(df: DataFrame, *, key: str, value: str, most: int, bits: int = 64) -> DataFrame:
    """(key, class, n_links), one row a row: its class of equal hashes and how many other rows are within ``most`` bits of it."""
    classes = hash_classes(df, key=key, value=value)
    members = df.select(key, F.col(value).alias("value")).join(classes.withColumnRenamed("rep", "class"), "value")
    return _counted(members, hamming_links(classes, most=most, bits=bits), key)


def hash_and_vector_links(df: DataFrame, *, key: str, value: str, vector: str, most: int, least: float, bits: int = 64) -> DataFrame:
    """(key, class, n_links), one row a row: rows near in both hash (``most`` bits) and vector (cosine of ``least`` or more).

    Rows of equal hash and vector are one class; candidates come from hashes, and vectors are fetched for them alone. Rows that
    share a hash but not a vector all meet, as nothing else tells them apart.
    """
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(vector).alias("vector")).filter("value IS NOT NULL")
    classes = rows.groupBy("value", "vector").agg(F.min("key").alias("class"), F.count("*").alias("n"))
    met = _met(classes.select(F.struct("class", "n").alias("item"), "value"), most, bits).select(F.col("x.item").alias("x"), F.col("y.item").alias("y"))
    end = lambda k: classes.select(F.col("class").alias(f"{k}_of"), F.col("vector").alias(f"v{k}"))
    met = met.join(end("x"), F.col("x.class") == F.col("x_of")).join(end("y"), F.col("y.class") == F.col("y_of"))
    links = met.filter(cosine(F.col("vx"), F.col("vy")) >= least).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    members = rows.join(classes, ["value", "vector"]).select(F.col("key").alias(key), "class", "n")
    return _counted(members, links, key)


#: Query vectors that one pass over the rows takes.
QUERY_BLOCK = 4096


def cosine_search(df: DataFrame, queries: DataFrame, *, key: str, vector: str, least: float, block: int = QUERY_BLOCK) -> DataFrame:
    """(a, b, cosine) of every query row a and every other row b at or above ``least``; exact.

    ``queries`` are a stated set of rows (key, vector). They are taken in blocks of ``block`` vectors; a block is one narrow
    pass over ``df``, as a matrix product in Arrow batches, and its results are cut to the shared folder before the next.
    Vectors of norm 0 have cosine 0. Rows without a key or vector are skipped.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter("key IS NOT NULL AND vector IS NOT NULL")
    asked = queries.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter("key IS NOT NULL AND vector IS NOT NULL")
    kind = dict(rows.dtypes)["key"]

    def passed(names: list, vectors: list[list[float]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((names, _unit(np.array(vectors, float))))  # ``block`` vectors at most

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, wanted = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch["key"].to_pylist()
                found = _unit(np.array(batch["vector"].to_pylist(), float)) @ wanted.T
                at, of = np.nonzero(found >= least)
                some = [(names[j], keys[i], float(found[i, j])) for i, j in zip(at.tolist(), of.tolist(), strict=True) if names[j] != keys[i]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], t) for c, t in enumerate((batch["key"].type, batch["key"].type, pa.float64()))], names=["a", "b", "cosine"])

        out = cut(rows.mapInArrow(near, f"a {kind}, b {kind}, cosine double"))
        shared.destroy()
        return out

    held, out = ([], []), None
    for row in asked.toLocalIterator():
        held[0].append(row["key"])
        held[1].append(row["vector"])
        if len(held[0]) == block:
            part, held = passed(*held), ([], [])
            out = part if out is None else out.unionByName(part)
    if held[0] or out is None:
        part = passed(*held) if held[0] else rows.limit(0).select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("cosine"))
        out = part if out is None else out.unionByName(part)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def clusters(items: DataFrame, links: DataFrame, key: str, *, value: str | None = None, src: str = "a", dst: str = "b") -> DataFrame:
    """(key, cluster): the least key of each item's component; items without a link stand alone.

    With ``value``, items of equal value are one class beforehand and ``links`` are between the classes' least keys.
    """
    found = connected_components(links, src, dst)
    if value is None:
        return items.select(key).join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", F.col(key)).alias("cluster"))
    classes = hash_classes(items, key=key, value=value).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = items.select(key, F.col(value).alias("value")).join(classes.select("value", F.coalesce("component", "rep").alias("cluster")), "value", "left")
    return named.select(key, F.coalesce("cluster", F.col(key)).alias("cluster"))


def dense_labels(clustered: DataFrame, key: str) -> DataFrame:
    """Clusters numbered from 0 in the order of their least keys: clusters are dealt out by ranges, and a window adds up one row a range."""
    ranged = clustered.select("cluster").distinct().repartitionByRange("cluster").sortWithinPartitions("cluster")
    ranged = cut(ranged.select("cluster", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    named = ranged.join(F.broadcast(before), "part").select("cluster", (F.col("before") + F.col("place")).cast("int").alias("label"))  # a row a partition
    return clustered.join(named, "cluster").select(key, "label")


# Spellings of a missing patient id.
_BLANK = ("", "nan", "None")


def group_keys(df: DataFrame, *, dataset: str = "source_dataset", patient: str | None = "patient_id", cluster: str = "dup_cluster_loose") -> DataFrame:
    """Adds group_key and group_key_provenance: the patient if known, else the loose duplicate cluster."""
    if cluster not in df.columns:
        df = df.withColumn(cluster, F.monotonically_increasing_id())
    ds = F.coalesce(F.col(dataset).cast("string"), F.lit("nan"))
    by_cluster = F.concat_ws("::", ds, F.lit("cluster"), F.coalesce(F.col(cluster).cast("string"), F.lit("nan")))
    if not patient or patient not in df.columns:
        return df.withColumn("group_key", by_cluster).withColumn("group_key_provenance", F.lit("cluster"))
    p = F.col(patient).cast("string")
    known = p.isNotNull() & ~F.trim(p).isin(*_BLANK)
    return df.withColumn("group_key", F.when(known, F.concat_ws("::", ds, F.lit("patient"), p)).otherwise(by_cluster)).withColumn("group_key_provenance", F.when(known, "patient").otherwise("cluster"))
