"""Line dedup by distinct-site spread.

A line (trimmed of ASCII white space; blank lines never count) is boilerplate if it stands on at least
``min_sites`` distinct sites. A HyperLogLog sketch of sites is built per line hash; sketches merge by
aggregation, so a line that everyone has is combined on the map side first. Lines whose estimate is
clearly above or below the threshold are settled by it; lines near it get an exact distinct count.
Boilerplate lines are then removed from every document of every site.

A line's key is 128 bits of hash. Removal is a narrow pass with the keys broadcast while there are at
most ``broadcast_lines`` of them (16 bytes each, counted first); beyond that, lines are joined by key.

Null texts have no lines; a null site counts as no site, but its documents are cleaned too. Repeated
rows each get a row, and add no site. Lines are removed whole and the rest keeps its order and its line breaks. A line
on exactly ``min_sites`` sites is boilerplate. A very long text is one row, cut into its lines. No rows give no rows.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import texts
from tessera.session import cut

MIN_SITES = 5
BROADCAST_LINES = 200_000
_LG_K = 10
_BLANK = b" \t\n\x0b\x0c\r"


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK.decode()))


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7).cast("long"), line).alias("k2")]


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(k1, k2, site) of every line that is not blank; map-side only."""
    rows = docs.select(F.col(site).alias("site"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    rows = rows.select("site", _trim(F.col("line")).alias("line")).filter(F.col("line") != "")
    return rows.select(*_key(F.col("line")), "site")


def boilerplate(docs: DataFrame, *, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(k1, k2) of the lines on at least ``min_sites`` distinct sites, cut to the shared folder."""
    rows = _lines(docs, text, site).filter(F.col("site").isNotNull())
    sketches = rows.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", _LG_K).alias("sketch"))
    spread = sketches.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("n")).filter(F.col("n") * 2 >= min_sites)
    spread = cut(spread)
    sure = spread.filter(F.col("n") > 2 * min_sites).select("k1", "k2")
    near = spread.filter(F.col("n") <= 2 * min_sites).select("k1", "k2")
    exact = rows.distinct().join(near, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    return cut(sure.unionByName(exact.select("k1", "k2")))


def _hashes(line: bytes) -> tuple[int, int]:
    """The key as Spark computes it: XXH64 with seed 42, and the same after hashing the number 7."""
    import xxhash

    return xxhash.xxh64_intdigest(line, 42), xxhash.xxh64_intdigest(line, xxhash.xxh64_intdigest((7).to_bytes(8, "little"), 42))


_RESULT = "struct<text:string,n_lines:bigint,n_removed:bigint>"


def _struct(rows: list[tuple[str | None, int, int]]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2))], names=["text", "n_lines", "n_removed"])


def _remover(shared):
    @F.arrow_udf(_RESULT)
    def remove(text: pa.Array) -> pa.Array:
        known, rows, missing = shared.value, [], text.is_null().to_pylist()
        for body, null in zip(texts(text), missing, strict=True):
            lines = body.split(b"\n")
            full = [(line, line.strip(_BLANK)) for line in lines]
            kept = [line for line, t in full if not t or _hashes(t) not in known]
            n = sum(1 for _, t in full if t)
            rows.append((None if null else b"\n".join(kept).decode("utf-8", "replace"), n, len(lines) - len(kept)))
        return _struct(rows)

    return remove.asNondeterministic()


def remove_boilerplate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """doc_id, text (cleaned), n_lines (not blank), n_removed of every document."""
    spark = docs.sparkSession
    keys = boilerplate(docs, text=text, site=site, min_sites=min_sites)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if keys.count() <= broadcast_lines:
        known = keys.toPandas().to_numpy(np.int64).view(np.uint64).reshape(-1, 2)
        shared = spark.sparkContext.broadcast({(a, b) for a, b in known.tolist()})
        return rows.select("doc_id", _remover(shared)("text").alias("_r")).select("doc_id", "_r.*")
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    lines = rows.select("rid", "doc_id", F.col("text").isNull().alias("null"), F.posexplode_outer(F.split("text", "\n")).alias("i", "line"))
    trimmed = _trim(F.coalesce("line", F.lit("")))
    lines = lines.withColumn("full", trimmed != "").withColumns(dict(zip(("k1", "k2"), _key(trimmed), strict=True)))
    lines = lines.join(keys.withColumn("bad", F.lit(True)), ["k1", "k2"], "left")
    bad = F.coalesce("bad", F.lit(False)) & F.col("full")
    kept = F.collect_list(F.when(~bad & F.col("line").isNotNull(), F.struct("i", "line")))
    found = lines.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("null").alias("null"), kept.alias("kept"), F.count_if("full").alias("n_lines"), F.count_if(bad).alias("n_removed"))
    body = F.array_join(F.transform(F.array_sort("kept"), lambda x: x["line"]), "\n")
    return found.select("doc_id", F.when(~F.col("null"), body).alias("text"), "n_lines", "n_removed")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_SQL_TRIM = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, source, i, ls[i] AS line FROM (SELECT rid, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
t AS (SELECT rid, source, i, line, {_SQL_TRIM} AS k FROM l),
b AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
r AS (SELECT t.rid, count(*) FILTER (WHERE t.k <> '') AS n_lines, count(b.k) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.k IS NULL) AS body FROM t LEFT JOIN b ON t.k = b.k GROUP BY t.rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN r USING (rid)
"""
