"""SimHash near-duplicates: 64-bit fingerprints, joined by descending a binary trie with itself.

Equal fingerprints are one class, so the trie holds each value once. The self-join walks pairs of trie
nodes together: a pair of a node with itself yields its two children and their cross pair, which costs
one differing bit; any other pair yields four, two of which cost one more; a pair over ``budget`` bits is
dropped with everything below it, and small pairs are compared directly.

To spread the join, fingerprints are dealt to ``budget + 1`` tables by one block of their bits each: two
values within the budget agree on at least one whole block, and that block is the upper trie, walked
with no budget left in it. Groups above ``hot`` values are dealt out once more, by blocks of the other
bits, up to ``levels`` times; that is exact for the same reason. Each task returns a spanning forest of its links and
not every pair, so the output is linear whatever the size of a group; components are then found by
star rounds over the checkpointed links.

A text without words has fingerprint zero and links like any other; null is such a text. Every input
row gets a row, repeated ones included; a null doc_id never names a component unless it is alone. A bit that
exactly half the shingles have is 0. A very long text is folded whole, some shingles at a time. No rows give no rows.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import LOWER, texts
from tessera.llm._rows import packed
from tessera.operators.components import connected_components
from tessera.session import cut, tidy

SHINGLE, SEED, BUDGET = 3, 42, 3
#: Ids up to this number are broadcast, more are joined.
MOST_NAMES = 2_000_000
_LEAF = 32
_FRONTIER = 1 << 20


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fold(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """Fingerprint of each text from all texts' hashes: a bit is set if over half of them have it."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.array(sizes) > 0
    if full.any():
        values = np.array(hashes, np.uint64)
        n = np.array(sizes, np.int64)[full]
        counts = np.zeros((len(n), 64), np.int64)
        edges = np.concatenate([[0], np.cumsum(n)])
        i = 0
        while i < len(n):  # bits of about 64k hashes at a time
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + 65536)) - 1)
            j = min(j, len(n))
            for a in range(int(edges[i]), int(edges[j]), 1 << 20) if j == i + 1 else [int(edges[i])]:
                b = min(int(edges[j]), a + (1 << 20)) if j == i + 1 else int(edges[j])
                bits = np.unpackbits(values[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                if j == i + 1:
                    counts[i] += bits.sum(axis=0, dtype=np.int64)
                else:
                    counts[i:j] = np.add.reduceat(bits, edges[i:j] - edges[i], axis=0, dtype=np.int32)
            i = j
        bits = (2 * counts > n[:, None]).astype(np.uint8)
        out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(all_texts: Iterator[bytes]) -> np.ndarray:
    parts, hashes, sizes = [], [], []
    for text in all_texts:
        found = shingle_hashes(text)
        hashes += found
        sizes.append(len(found))
        if len(hashes) > 1 << 18:
            parts.append(fold(hashes, sizes))
            hashes, sizes = [], []
    parts.append(fold(hashes, sizes))
    return np.concatenate(parts)


def _fingerprint(text: pa.Array) -> pa.Array:
    return pa.array(fingerprints(texts(text)).view(np.int64), pa.int64())


# ---- the trie


def trie_join(values: np.ndarray, keys: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with equal keys whose values differ in at most ``budget`` bits.

    ``values`` (uint64) are sorted and distinct within each run of equal ``keys``. Node pairs are
    (low, high, low, high, errors, depth); the stack holds blocks of bounded size, deepest first.
    """
    n = len(values)
    if n < 2:
        return
    bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [n]])
    lo, hi = bounds[:-1], bounds[1:]
    some = hi - lo > 1
    lo, hi = lo[some], hi[some]
    ones: dict[int, np.ndarray] = {}
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int8), 0)] if len(lo) else []
    while stack:
        a, b, c, d, e, depth = stack.pop()
        if len(a) > _FRONTIER:
            half = len(a) // 2
            stack += [(a[half:], b[half:], c[half:], d[half:], e[half:], depth), (a[:half], b[:half], c[:half], d[:half], e[:half], depth)]
            continue
        small = (b - a) * (d - c) <= _LEAF
        if depth == 64:
            small[:] = True
        if small.any():
            yield from _leaves(values, a[small], b[small], c[small], d[small], budget)
            big = ~small
            a, b, c, d, e = a[big], b[big], c[big], d[big], e[big]
        if not len(a):
            continue
        if depth not in ones:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        up = ones[depth]
        m, k = b - (up[b] - up[a]), d - (up[d] - up[c])
        same = (a == c) & (b == d)
        other = ~same
        parts = [
            (a, m, c, k, e), (m, b, k, d, e),
            (a, m, k, d, e + 1),
            (m[other], b[other], c[other], k[other], e[other] + 1),
        ]
        a, b, c, d, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (b > a) & (d > c) & (e <= budget) & ~((a == c) & (b == d) & (b - a == 1))
        if live.any():
            stack.append((a[live], b[live], c[live], d[live], e[live], depth + 1))


def _leaves(values: np.ndarray, a, b, c, d, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(a), 1 << 16):
        s = slice(at, at + (1 << 16))
        wide, high = (d - c)[s], (b - a)[s]
        size = wide * high
        pair = np.repeat(np.arange(len(size)), size)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        i, j = a[s][pair] + inner // wide[pair], c[s][pair] + inner % wide[pair]
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        near &= i != j
        i, j = i[near], j[near]
        yield np.minimum(i, j), np.maximum(i, j)


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index of each item's component."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            i, j = root[i], root[j]
            apart = i != j
            i, j = i[apart], j[apart]
            if len(i):
                low, high = np.minimum(i, j), np.maximum(i, j)
                np.minimum.at(root, high, low)
                i, j = high, low
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
    return root


def _join_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, value), a key's rows together and in order of value -> links (src, dst) of values."""

    def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        root = spanning(len(values), trie_join(values, keys))
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(values[far].view(np.int64)), pa.array(values[root[far]].view(np.int64))], names=["src", "dst"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        rows += batch.num_rows
        if rows < 1 << 18:
            continue
        keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
        end = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        if end:
            yield links(keys[:end], values[:end])
        held, rows = [(keys[end:], values[end:])], len(keys) - end
    if rows:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), n)]


def _extract(bits: list[int]) -> F.Column:
    """The value's bits as a number; ``bits`` ascend and lie in a few runs."""
    runs, out, width = [], F.lit(0).cast("long"), 0
    for bit in bits:
        if runs and bit == runs[-1][0] + runs[-1][1]:
            runs[-1][1] += 1
        else:
            runs.append([bit, 1])
    for low, size in runs:
        part = F.shiftrightunsigned("value", low).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, width))
        width += size
    return out


def near_links(values: DataFrame, *, budget: int = BUDGET, hot: int = 20_000, levels: int = 2) -> DataFrame:
    """``values``: distinct fingerprints (value). A spanning set of links (src, dst) within the budget."""
    tables = budget + 1

    def deal(rows: DataFrame, free: list[int], path: F.Column) -> list[tuple[DataFrame, list[int]]]:
        return [(rows.select(F.xxhash64(path, F.lit(i), _extract(block)).alias("key"), "value"), [b for b in free if b not in block]) for i, block in enumerate(_blocks(free, tables))]

    todo, links = deal(values, list(range(64)), F.lit(0)), []
    for level in range(levels + 1):
        keyed = [x.withColumn("free", F.lit(i)) for i, (x, _) in enumerate(todo)]
        rows = keyed[0]
        for x in keyed[1:]:
            rows = rows.unionByName(x)
        if level < levels:
            crowded = rows.groupBy("key", "free").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
            crowded = cut(crowded)
            if crowded.isEmpty():
                levels_left = False
            else:
                levels_left = True
                again = rows.join(crowded.select("key", "free"), ["key", "free"], "left_semi")
                rows = rows.join(crowded.select("key", "free"), ["key", "free"], "left_anti")
        else:
            levels_left = False
        links.append(rows.select("key", "value").repartition("key").sortWithinPartitions("key").mapInArrow(_join_partition, "src bigint, dst bigint"))
        if not levels_left:
            break
        again = cut(again)
        todo = [t for i, (_, free) in enumerate(todo) for t in deal(again.filter(F.col("free") == i), free, F.col("key"))]
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row a document: doc_id, value (the fingerprint as a signed number), component_id."""
    prints = cut(docs.select(F.col(doc_id).alias("doc_id"), F.arrow_udf(_fingerprint, "bigint").asNondeterministic()(F.col(text)).alias("value")))
    classes = cut(prints.groupBy("value").agg(F.min("doc_id").alias("least")))
    links = near_links(classes.select("value"), **options)
    groups = connected_components(links)  # few: only values that have a near one
    named = classes.join(groups.withColumnRenamed("node", "value"), "value", "left").withColumn("component", F.coalesce("component", "value"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("value", "component_id")
    return prints.join(named, "value").select("doc_id", "value", "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", search: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component that ``search`` finds the document with the least doc_id stays.

    Rows that repeat a doc_id with the same text are one document, and the one whose other columns come
    first, read as text and in their order, stays. Documents without a doc_id cannot be named by a component;
    they stay, one of each text. Columns of any name are carried. No rows give no rows. Texts are shuffled
    only where ids repeat or more than ``MOST_NAMES`` documents go.
    """
    with tidy(docs.sparkSession):
        found = cut(search(docs, doc_id=doc_id, text=text, **options))
        per = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
        odd = cut(per.filter("NOT stays OR n > 1").select("doc_id", "stays"))  # all other documents stay as they are
    few = odd.count() <= MOST_NAMES
    held = lambda ids: F.broadcast(ids) if few else ids
    rows = packed(docs).withColumn("doc_id", F.col(f"row.`{doc_id}`"))
    others = [F.col(f"row.`{c}`").cast("string") for c in docs.columns if c not in (doc_id, text)] or [F.lit(0)]
    once = lambda some: some.groupBy("doc_id", F.col(f"row.`{text}`").alias("text")).agg(F.min_by("row", F.struct(*others)).alias("row")).select("row.*")
    out = rows.filter(F.col("doc_id").isNotNull()).join(held(odd.select("doc_id")), "doc_id", "left_anti").select("row.*")
    if not odd.filter("stays").isEmpty():
        out = out.unionByName(once(rows.join(held(odd.filter("stays").select("doc_id")), "doc_id", "left_semi")))
    if not found.filter(F.col("doc_id").isNull()).isEmpty():
        out = out.unionByName(once(rows.filter(F.col("doc_id").isNull())))
    return out
