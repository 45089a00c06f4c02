"""Benchmark decontamination by Wu-Manber multi-pattern search.

A text becomes its lower-cased words with one space before, between and after them; a test window
becomes the same kind of byte string, so a window occurs exactly where its bytes occur. Windows are
grouped by length. Each group has a shift table, indexed by a hash of eight bytes (a block): how far
the search may jump when it reads that block at the end of the search frame. Where the jump is zero,
a bucket of windows that carry this block there is looked up and each one is compared byte by byte.
Many stretches of a chunk of texts advance together, as one numpy vector of positions.

The windows are a stated query set. They are taken in blocks of at most ``block_bytes`` of test text;
one block is one narrow pass over the documents (no shuffle), and beyond one block the state is cut
to the shared folder between the passes, so neither the driver nor a worker holds more than a block.

Null and empty texts have no words. An empty benchmark hits nothing, and no documents give no rows. A very long
text is a chunk of its own and is searched whole. A test text that occurs twice counts under both its ids; a null
id marks words as hit but names no item. Repeated document rows each get a row. ``decontaminate`` reads the named
columns alone, so others cannot clash; ``with_hits`` adds one column, whose name the caller chooses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import WORD_OR_SPACE, chunks, utf8
from tessera.session import cut

WINDOW = 10
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LANE = 1024
_TABLE = np.frombuffer(WORD_OR_SPACE, np.uint8)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_OR_SPACE).split()


def windows(items: Iterable[tuple[object, str | None]], width: int = WINDOW) -> dict[bytes, set[str]]:
    """Byte string of each window -> ids of the items that hold it."""
    out: dict[bytes, set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            found = out.setdefault(b" " + b" ".join(words[i : i + width]) + b" ", set())
            if item is not None:
                found.add(str(item))
    return out


class Group:
    """Tables for windows of similar length."""

    def __init__(self, patterns: list[tuple[bytes, int]]) -> None:
        self.m = m = min(len(p) for p, _ in patterns)
        self.block = b = min(8, m)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        self.bits = max(12, min(24, int(np.ceil(np.log2(len(patterns) * (m - b + 1) + 1))) + 1))
        head = np.frombuffer(b"".join(p[:m] for p, _ in patterns) + bytes(8), np.uint8)
        starts = np.arange(len(patterns)) * m
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        for j in range(m - b + 1):
            np.minimum.at(self.shift, self.slot(self.read(head, starts + j)), m - b - j)
        last = self.read(head, starts + m - b)
        order = np.argsort(last, kind="stable")
        self.last = last[order]
        self.patterns = [patterns[i] for i in order]

    def read(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[at] & self.mask

    def slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, data: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """(position, window) of every occurrence in ``data[:n]``; eight more bytes must follow."""
        if n < self.m:
            return
        at = np.arange(0, n - self.m + 1, _LANE)
        end = np.minimum(at + _LANE, n - self.m + 1)
        reach, found, blocks = self.m - self.block, [], []
        while len(at):
            block = self.read(data, at + reach)
            step = self.shift[self.slot(block)]
            if len(zero := np.flatnonzero(step == 0)):
                found.append(at[zero])
                blocks.append(block[zero])
            at = at + np.maximum(step, 1)
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        if not found:
            return
        at, block = np.concatenate(found), np.concatenate(blocks)
        lo, hi = np.searchsorted(self.last, block, "left"), np.searchsorted(self.last, block, "right")
        some = hi > lo
        view = memoryview(data)
        for p, a, b in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
            for k in range(a, b):
                pattern, index = self.patterns[k]
                if view[p : p + len(pattern)] == pattern:
                    yield p, index


class WuManber:
    """Searches all windows of a block of test items."""

    def __init__(self, found: dict[bytes, set[str]]) -> None:
        self.items = [sorted(x) for x in found.values()]
        self.n_words = [p.count(b" ") - 1 for p in found]
        by_class: dict[int, list[tuple[bytes, int]]] = {}
        for i, p in enumerate(found):
            by_class.setdefault(min(6, len(p).bit_length()), []).append((p, i))
        self.groups = [Group(x) for _, x in sorted(by_class.items())]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Words of each text, and by text its hit word runs (start, end) and the items that occur."""
        n = len(offsets) - 1
        size = int(offsets[-1] - offsets[0])
        # Each text is laid down as: end mark, space, text, space.
        flat = np.full(size + 3 * n + 1, 32, np.uint8)
        marks = offsets[:-1] - offsets[0] + 3 * np.arange(n)
        source = _TABLE[data[offsets[0] : offsets[-1]]]
        flat[np.arange(size) + np.repeat(3 * np.arange(n) + 2, np.diff(offsets))] = source
        flat[marks] = 0
        flat[-1] = 0
        space = flat == 32
        keep = np.ones(len(flat), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        flat = flat[keep]
        length = len(flat)
        starts = np.flatnonzero((flat[:-1] == 32) & (flat[1:] != 0)) + 1
        ends = np.flatnonzero(flat == 0)
        first = np.searchsorted(starts, ends)
        flat = np.concatenate([flat, np.zeros(8, np.uint8)])
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for group in self.groups:
            for p, index in group.search(flat, length):
                word = int(np.searchsorted(starts, p + 1))
                doc = int(np.searchsorted(first, word, "right")) - 1
                word -= int(first[doc])
                spans.setdefault(doc, []).append((word, word + self.n_words[index]))
                items.setdefault(doc, set()).update(self.items[index])
        return np.diff(first), {k: merged(v) for k, v in spans.items()}, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_STATE = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"


def _scanner(searcher, state: bool):
    """An Arrow function text[, state] -> state, with what this block of windows adds."""

    def run(text: pa.Array, old: pa.Array | None = None) -> pa.Array:
        data, offsets = utf8(text)
        wm, out = searcher.value, []
        before = old.to_pylist() if old is not None else None
        for i, j in chunks(offsets, 4 << 20):
            n_words, spans, items = wm.scan(data, offsets[i : j + 1])
            for k in range(j - i):
                runs, names = spans.get(k, []), items.get(k, ())
                if before:
                    was = before[i + k]
                    runs = merged([*zip(was["starts"], was["ends"], strict=True), *runs])
                    names = {*was["items"], *names}
                out.append((int(n_words[k]), [a for a, _ in runs], [b for _, b in runs], sorted(names)))
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[c] for x in out], pa.list_(pa.int64())) for c in (1, 2)), pa.array([x[3] for x in out], pa.list_(pa.string()))],
            names=["n_words", "starts", "ends", "items"],
        )

    if state:

        def step(text: pa.Array, old: pa.Array) -> pa.Array:
            return run(text, old)
    else:

        def step(text: pa.Array) -> pa.Array:
            return run(text)

    return F.arrow_udf(step, _STATE).asNondeterministic()


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of at most ``block_bytes`` of text (or one longer item), read one partition at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col(item), F.col(text)).toLocalIterator():
        n = len((row[1] or "").encode())
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    yield held


def with_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 8 << 20, out: str = "_hits") -> DataFrame:
    """``docs`` and a struct ``out``: n_words, hit word runs (starts, ends), items whose windows occur."""
    context = docs.sparkSession.sparkContext
    name, done = out, False
    for block in _blocks(benchmark, item, item_text, block_bytes):
        searcher = context.broadcast(WuManber(windows(block, window)))
        if done:  # a further block: the state so far is in the shared folder
            docs = cut(docs).withColumn(name, _scanner(searcher, True)(text, name))
        else:
            docs, done = docs.withColumn(name, _scanner(searcher, False)(text)), True
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items, starts, ends, contaminated."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hits = with_hits(narrow, benchmark, text="text", out="_hits", **options).select("doc_id", "_hits.*")
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the operator's result."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def items_digest(names: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return digest(decontaminate(docs, items))


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[p : p + {WINDOW - 1}], ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - {WINDOW - 2}))) AS p FROM i WHERE len(ws) > 0)),
g AS (SELECT rid, n, p, array_to_string(ws[p : p + n - 1], ' ') AS g
      FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d JOIN (SELECT DISTINCT n FROM w) ON len(ws) >= n)),
o AS (SELECT rid, n, p, item_id FROM g JOIN w USING (n, g)),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM o) GROUP BY rid),
t AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (WHERE item_id IS NOT NULL)) AS items FROM o GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
