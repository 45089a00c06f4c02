"""Language ID by rank-order profiles.

Letters (in any script) are lower-cased, every run of other characters is one word boundary. The most
frequent 1- to 3-grams of a language, by rank, are its profile. A text's own most frequent n-grams are
compared with each profile by out-of-place distance: the sum of rank differences, with a fixed penalty
for an n-gram that the profile lacks. The least distance wins; ties go to the lesser name.

Profiles are fitted on labelled rows only, on a sample of at most about ``fit_rows`` documents a
language, taken by a hash of doc_id (a documented bound; every language is sampled at the rate that
its own count allows). Counting is partial in each partition and then by (language, n-gram); what
reaches the driver is ``profile`` n-grams a language. Prediction is one narrow pass over whole texts.

Null texts and texts without a letter are ``und`` with score 0. With no labelled rows all is ``und``, and no rows
give no rows. A very long text is profiled whole. Repeated rows each get a row, and each count where they are learned
from. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._arrow import chunks, utf8

ORDERS = (1, 2, 3)
PROFILE = 400
FIT_ROWS = 4000
_BITS = 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> lower-cased letter, or 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def stream(text: bytes) -> np.ndarray:
    """Lower-cased letters with single zeros before, between and after the words."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    line = np.zeros(len(points) + 2, np.uint32)
    line[1:-1] = letters()[points]
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != 0) | (line[:-1] != 0)
    return line[keep].astype(np.uint64)


def grams(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a stream, each packed in one number, and their counts."""
    if not line.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one = np.uint64(_BITS)
    single = line[line != 0]
    double = (line[:-1] << one) | line[1:] | np.uint64(1 << 62)
    inner = line[1:-1] != 0
    triple = ((line[:-2] << (one + one)) | (line[1:-1] << one) | line[2:])[inner] | np.uint64(1 << 63)
    return np.unique(np.concatenate([single, double, triple]), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in rank order; ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE) -> None:
        self.names = sorted(ranked)
        self.size = size
        known = sorted({c for x in ranked.values() for c in x})
        self.codes = np.array(known, np.uint64)
        place = {c: i for i, c in enumerate(known)}
        self.ranks = np.full((len(self.names), len(known) + 1), -1, np.int64)  # the last column: not known
        for i, name in enumerate(self.names):
            for rank, code in enumerate(ranked[name]):
                self.ranks[i, place[code]] = rank

    def predict(self, text: bytes) -> tuple[str, float]:
        codes, counts = grams(stream(text))
        if not len(codes) or not self.names:
            return "und", 0.0
        best = top(codes, counts, self.size)
        if len(self.codes):
            at = np.searchsorted(self.codes, best)
            at[at == len(self.codes)] = 0
            at = np.where(self.codes[at] == best, at, len(self.codes))
        else:
            at = np.zeros(len(best), np.int64)
        ranks = self.ranks[:, at]
        gap = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(best))))
        distance = gap.sum(axis=1)
        i = int(np.argmin(distance))
        return self.names[i], 1.0 - float(distance[i]) / (self.size * len(best))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def settle(lang: str) -> None:
        codes, counts = totals.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        pieces = held.pop(lang)
        all_codes = np.concatenate([codes, *[c for c, _ in pieces]])
        all_counts = np.concatenate([counts, *[n for _, n in pieces]])
        found, back = np.unique(all_codes, return_inverse=True)
        totals[lang] = (found, np.bincount(back, all_counts, len(found)).astype(np.int64))

    for batch in batches:
        data, offsets = utf8(batch.column(1))
        view = memoryview(data)
        for lang, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            held.setdefault(lang, []).append(grams(stream(bytes(view[a:b]))))
            if len(held[lang]) >= 256:
                settle(lang)
    for lang in list(held):
        settle(lang)
    for lang, (codes, counts) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "code", "n"])


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, profile: int = PROFILE) -> Profiles:
    """Profiles from the rows of ``docs`` that may be learned from (not held out, labelled)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}  # a row a language
    if not sizes:
        return Profiles({}, profile)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, fit_rows / n) * (1 << 20)) + 1)) for k, n in sorted(sizes.items())])
    counted = rows.filter(draw < limit).select("lang", "text").mapInArrow(_count, "lang string, code bigint, n bigint")
    counted = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # As unsigned numbers, ties go to the lesser code; flipping the top bit gives that order.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("code").bitwiseXOR(F.lit(-(1 << 63))))
    best = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= profile)
    ranked: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():  # profile rows a language
        ranked.setdefault(r["lang"], []).append((r["rank"], r["code"] % (1 << 64)))
    return Profiles({k: [c for _, c in sorted(v)] for k, v in ranked.items()}, profile)


def predictor(spark: SparkSession, profiles: Profiles):
    """An Arrow function text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(profiles)  # profile codes a language: a fixed size

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        view, found = memoryview(data), []
        for i, j in chunks(offsets, 1 << 20):
            found += [shared.value.predict(bytes(view[offsets[k] : offsets[k + 1]])) for k in range(i, j)]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=["lang_pred", "score"])

    return predict.asNondeterministic()


def identify(docs: DataFrame, profiles: Profiles | None = None, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    profiles = profiles or fit(docs, doc_id=doc_id, text=text, lang=lang, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), predictor(docs.sparkSession, profiles)(F.col(text)).alias("_p"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_p.lang_pred", "_p.score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
