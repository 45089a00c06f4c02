"""Exact removal of repeated 200-byte strings by suffix sorting.

Dealing out. Every start of a 200-byte string has an anchor: the place of the least 8-byte hash among the
first ``REACH`` places of the string. The anchor depends on the string alone, so equal strings have equal
anchors, and also equal bytes from the anchor to ``length - REACH`` after it; their hash is the key by
which starts are dealt out. Starts that share an anchor are one run; its context is the run with the bytes
its strings reach. A key that occurs once cannot hold a repeat. Runs whose whole contexts are equal (128
bits of hash) are repeats of each other and are settled without their text. What is left are keys with
two or more different contexts: one run of each context is fetched and their texts are suffix-sorted.

Suffix sorting is induced sorting: the suffixes that begin a rise (S*) are ordered first, from
them all falling suffixes (L) are induced in one ascending scan and all rising ones (S) in one descending
scan. Suffix tuples travel through a priority queue that keeps them by first byte and order of arrival
and moves to disk when it outgrows its share of memory; each tuple carries its common prefix with the
tuple before it, which is induced as well: one more than the least common prefix of the sources between
them. Names of S* substrings form the reduced string. As only ``length`` bytes matter, the reduced string
is ranked by doubling its names instead of by further levels of induction. A start is repeated if its
common prefix with a neighbour reaches ``length``.

Before that, the starts of each run are settled the same way once more, 16 offsets from the anchor at a
time, so that only texts near a difference are sorted. Shards are cut at key boundaries into batches of a
few MB. A key with more than ``HOT`` contexts is dealt out again by those classes of offsets, so that no
key has to fit a task.

Null and empty texts have no bytes. Bytes are those of UTF-8; repeats within a document count. Rows are
told apart by their place in the input, which must be a stable scan (files or a checkpoint); repeated
rows are copies of each other, and all of both goes. A text longer than a segment is taken in overlapping pieces. No
rows give no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import chunks, utf8
from tessera.session import shared_dir

LENGTH, REACH, HOT = 200, 150, 5000
_CLASS = 16
_SEGMENT = 8 << 20
_BATCH = 4 << 20
_HELD = 1 << 19
_LOW = np.uint64(0xFFFFFF)

# ---- anchors


def _least(data: np.ndarray, reach: int) -> np.ndarray:
    """For each place, the place of the least 8-byte hash among it and the ``reach - 1`` after it."""
    v = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
    v *= np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v &= ~_LOW
    v |= np.arange(len(v), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < reach:
        v = np.minimum(v[: len(v) - (reach - size)], v[reach - size :])
    return (v & _LOW).astype(np.int64)


def runs(data: np.ndarray, starts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor) of each run; ``starts`` ascend, ``data`` has ``reach + 8`` bytes to spare."""
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    anchor = _least(data, reach)[starts]
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return starts[fresh], np.diff(np.append(fresh, len(starts))), anchor[fresh]


def _anchors(length: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, tail = xxhash.xxh64_intdigest, length - reach + 1
        spare = np.zeros(reach + 8, np.uint8)
        for batch in batches:
            rid = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            out: list[list] = [[], [], [], []]
            for i, j in chunks(offsets, 1 << 20):
                # A text longer than a segment is taken in pieces that overlap by one string.
                for low in range(0, max(1, int(offsets[j] - offsets[i])), _SEGMENT):
                    high = min(int(offsets[j] - offsets[i]), low + _SEGMENT + length - 1)
                    part = np.concatenate([data[offsets[i] + low : offsets[i] + high], spare])
                    edges = np.clip(offsets[i : j + 1] - offsets[i] - low, 0, high - low)
                    n = np.maximum(np.diff(edges) - length + 1, 0)
                    starts = np.arange(n.sum()) + np.repeat(edges[:-1] - (np.cumsum(n) - n), n)
                    first, size, anchor = runs(part, starts, reach)
                    doc = np.searchsorted(edges, first, "right") - 1
                    place = first - (offsets[i + doc] - offsets[i] - low)
                    view = memoryview(part)
                    out[0] += [digest(view[p : p + tail], 1) for p in anchor.tolist()]
                    out[1] += [digest(view[a : a + k + length - 1], p - a) for a, k, p in zip(first.tolist(), size.tolist(), anchor.tolist(), strict=True)]
                    out[2].append(rid[i + doc])
                    out[3].append(place << 16 | size)
            if out[0]:
                columns = [np.array(out[0], np.uint64).view(np.int64), np.array(out[1], np.uint64).view(np.int64), np.concatenate(out[2]), np.concatenate(out[3])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "ctx", "rid", "place"])

    return run


# ---- keys: what is settled and what needs its text

_SETTLED, _ALONE, _SHARED = 0, 1, 2


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (key, ctx) -> settled runs, and one run of each context of keys with several."""

    def settle(rows: np.ndarray, going_on: bool, came_on: bool) -> pa.RecordBatch:
        key, ctx = rows[0], rows[1]
        fresh_key = np.concatenate([[True], key[1:] != key[:-1]])
        fresh = fresh_key | np.concatenate([[True], ctx[1:] != ctx[:-1]])
        of = np.cumsum(fresh) - 1
        many = np.bincount(of) > 1
        first = np.flatnonzero(fresh)
        group = (np.cumsum(fresh_key) - 1)[first]
        contexts = np.bincount(group)
        contested = (contexts > 1)[group]
        # A key that was too long to hold at once: its contexts may be compared in vain, none is missed.
        contested |= (group == 0) & came_on | (group == group[-1]) & going_on
        settled = np.flatnonzero(many[of])
        asked = first[contested]
        kind = np.where(many[contested], _SHARED, _ALONE) + 10 * (contexts[group[contested]] > HOT)
        if came_on or going_on:
            kind += 10 * (kind < 10)
        take = np.concatenate([settled, asked])
        kinds = np.concatenate([np.full(len(settled), _SETTLED), kind]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(rows[c][take]) for c in (0, 2, 3))], names=["kind", "key", "rid", "place"])

    held: list[np.ndarray] = []
    n, came_on = 0, False
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in range(4)]))
        n += batch.num_rows
        if n < _HELD:
            continue
        rows = np.concatenate(held, axis=1)
        end = int(np.flatnonzero(rows[0] != rows[0, -1])[-1]) + 1 if rows[0, 0] != rows[0, -1] else 0
        if end:
            yield settle(rows[:, :end], False, came_on)
            rows, came_on = rows[:, end:], False
        elif n > 8 * _HELD:  # one key: cut it
            yield settle(rows[:, :-2], True, came_on)
            rows, came_on = rows[:, -2:], True
        held, n = [rows], rows.shape[1]
    if n:
        yield settle(np.concatenate(held, axis=1), False, came_on)


def classes(n: int, anchor: int) -> Iterator[tuple[int, int, int]]:
    """(first start, number, common place) of the starts of a run, by 16 offsets from the anchor at a time.

    Strings of one class that equal each other agree, beside their own bytes, on the ``length - 15`` bytes
    from the common place on, wherever their runs begin and end. Places count from the run's first start.
    """
    for c in range((anchor - n + 1) // _CLASS, anchor // _CLASS + 1):
        a, b = max(0, anchor - _CLASS * (c + 1) + 1), min(n - 1, anchor - _CLASS * c)
        if a <= b:
            yield a, b - a + 1, anchor - _CLASS * c


_PIECES = "key bigint, alone boolean, rid bigint, start bigint, anchor int, piece binary"


def _pieces(length: int, reach: int):
    """(rid, text, asked runs) -> the run's key, whether it stands alone, its place, anchor and text."""
    schema = pa.schema([("key", pa.int64()), ("alone", pa.bool_()), ("rid", pa.int64()), ("start", pa.int64()), ("anchor", pa.int32()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        spare = np.zeros(reach + 8, np.uint8)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            data, offsets = utf8(batch.column(1))
            view = memoryview(data)
            size = 0
            for rid, base, asked in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), batch.column(2).to_pylist(), strict=True):
                for x in asked:
                    start, n, kind = x["place"] >> 16, x["place"] & 0xFFFF, x["kind"]
                    low = base + start
                    text = np.concatenate([data[low : low + n + length - 1], spare])
                    anchor = int(_least(text[: reach + reach + 7], reach)[0])
                    parts = [(x["key"], 0, n)]
                    if kind >= 10:  # a crowded key
                        parts = []
                        for a, k, common in classes(n, anchor):
                            key = xxhash.xxh64_intdigest(view[low + common : low + common + length - _CLASS + 1], _CLASS + anchor - common)
                            parts.append((key - (1 << 64) if key >= 1 << 63 else key, a, k))
                    for key, a, k in parts:
                        piece = bytes(view[low + a : low + a + k + length - 1])
                        size += len(piece)
                        for column, value in zip(rows, (key, kind % 10 == _ALONE, rid, start + a, anchor - a, piece), strict=True):
                            column.append(value)
                if size > _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, size = [[] for _ in schema], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


# ---- induced sorting


class BucketQueue:
    """A monotone priority queue of suffix tuples (place, common prefix): by first symbol, then by arrival.

    Tuples beyond ``limit`` bytes go to a file in the task's own scratch folder, which is deleted with the queue.
    """

    def __init__(self, symbols: int, limit: int = 2 << 20) -> None:
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.limit, self.held, self.file = limit, 0, None

    def push(self, symbol: int, places: np.ndarray, common: np.ndarray) -> None:
        self.parts[symbol].append((places, common))
        self.held += places.nbytes + common.nbytes
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.file.seek(0, os.SEEK_END)
        for parts in self.parts:
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    parts[i] = (at, len(part[0]))
        self.held = 0

    def load(self, part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            return part
        at, n = part
        self.file.seek(at)
        places = np.frombuffer(self.file.read(4 * n), np.int32)
        return places, np.frombuffer(self.file.read(n), np.uint8)

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The tuples of a symbol that are in the queue now, oldest first."""
        if not self.parts[symbol]:
            return None
        parts = [self.load(p) for p in self.parts[symbol]]
        self.held -= sum(p[0].nbytes + p[1].nbytes for p in self.parts[symbol] if isinstance(p[0], np.ndarray))
        self.parts[symbol] = []
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _rank(values: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    fresh = np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)])
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(fresh)
    return rank, int(fresh.sum()) + 1


class Sorter:
    """Order and common prefixes (at most ``cap``) of all suffixes of a string of small numbers that ends in its only 0."""

    def __init__(self, text: np.ndarray, cap: int = LENGTH, limit: int = 2 << 20) -> None:
        self.t, self.cap, self.limit, self.n = text, cap, limit, len(text)
        self.symbols = int(text.max()) + 1
        step = np.sign(np.diff(text.astype(np.int32))).astype(np.int8)
        where = np.where(step != 0, np.arange(self.n - 1, dtype=np.int32), np.int32(self.n - 2))
        where = np.minimum.accumulate(where[::-1])[::-1] if self.n > 1 else where
        self.rising = np.concatenate([step[where] > 0, [True]]) if self.n > 1 else np.array([True])
        self.star = np.flatnonzero(self.rising[1:] & ~self.rising[:-1]).astype(np.int32) + np.int32(1)

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs, which agree on ``known`` symbols."""
        out = np.minimum(known, self.cap).astype(np.int64)
        wide = np.ndarray((self.n,), "<u8", np.concatenate([self.t, np.zeros(4, np.uint16)]), strides=(2,))
        live = np.flatnonzero(out < self.cap)
        while len(live):
            i, j = a[live] + out[live], b[live] + out[live]
            inside = (i < self.n) & (j < self.n)
            live, i, j = live[inside], i[inside], j[inside]
            gap = wide[i] ^ wide[j]
            low = gap & (~gap + np.uint64(1))  # the lowest differing bit
            same = np.where(gap == 0, 4, (np.bitwise_count(low - np.uint64(1)) >> 4).astype(np.int64))
            out[live] += same
            live = live[(gap == 0) & (out[live] < self.cap)]
        return np.minimum(out, self.cap)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """S* suffixes in order, each with its common prefix with the one before."""
        star, n = self.star.astype(np.int64), len(self.star)
        code = self.t.astype(np.uint64) * np.uint64(2) + self.rising
        # Name S* substrings (to the next S*, inclusive, types included) by a polynomial hash, then order the distinct ones.
        base = np.uint64(0x9E3779B97F4A7C15 | 1)
        back = np.uint64(pow(int(base), -1, 1 << 64))
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.n, base)]))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.n, back)]))
        mixed = (code + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power[:-1])])
        end = np.append(star[1:], self.n - 1)
        name = (total[end + 1] - total[star]) * inverse[star]
        del power, inverse, mixed, total
        _, first, name = np.unique(name, return_index=True, return_inverse=True)
        plain = code.astype(">u2").tobytes()
        words = [plain[2 * a : 2 * b + 2] for a, b in zip(star[first].tolist(), end[first].tolist(), strict=True)]
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        levels, size, found = [rank[name]], 1, len(words)
        while found < n and 2 * size < self.cap + 2:
            r = levels[-1]
            after = np.zeros(n, np.int64)
            after[:-size] = r[size:] + 1
            r, found = _rank((r << 32) | after)
            levels.append(r)
            size *= 2
        order = np.argsort(levels[-1], kind="stable")
        # Common prefixes: whole names by the ranks of each level, the rest symbol by symbol.
        a, b = order[1:].copy(), order[:-1].copy()
        for k in range(len(levels) - 1, -1, -1):
            r, inside = levels[k], np.maximum(a, b) + (1 << k) < n
            same = np.zeros(len(a), bool)
            same[inside] = r[a[inside]] == r[b[inside]]
            a[same] += 1 << k
            b[same] += 1 << k
        known = star[a] - star[order[1:]]
        common = self.common(star[order[1:]], star[order[:-1]], known) if n > 1 else np.zeros(0, np.int64)
        return self.star[order], np.concatenate([[0], common]).astype(np.uint8)[:n]

    def _induce(self, symbols: Iterator[int], rising: bool, after: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """One scan: in each bucket the queue's tuples, then those of ``after``, induce what stands before them."""
        queue, done = BucketQueue(self.symbols, self.limit), {}
        least = np.zeros(self.symbols, np.uint8)  # by bucket: the least common prefix since its last tuple
        for symbol in symbols:
            least[:] = 0
            own: list[tuple[np.ndarray, np.ndarray]] = []
            fed = False
            while True:
                part = queue.take(symbol)
                if part is not None:
                    own.append(part)
                    places, common = part
                    if len(own) == 1:
                        common = np.concatenate([[np.uint8(0)], common[1:]])
                elif not fed and symbol in after:
                    fed = True
                    places, common = after[symbol]
                    seam = self.common(np.array([own[-1][0][-1]], np.int64), places[:1].astype(np.int64), np.zeros(1, np.int64))[0] if own else 0
                    common = np.concatenate([[np.uint8(seam)], common[1:]])
                else:
                    break
                self._feed(queue, places, common, least, rising)
            if own:
                done[symbol] = (np.concatenate([p for p, _ in own]), np.concatenate([c for _, c in own]))
        queue.close()
        return done

    def _feed(self, queue: BucketQueue, places: np.ndarray, common: np.ndarray, least: np.ndarray, rising: bool) -> None:
        at = np.flatnonzero(places > 0)
        at = at[self.rising[places[at] - 1] == rising]
        before = places[at] - 1
        symbol = self.t[before]
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        edges = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(at) else np.zeros(0, np.int64)
        # Least common prefix over each stretch of sources between two tuples of one bucket.
        table = [common]
        while 2 << (len(table) - 1) <= len(common):
            w = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-w], table[-1][w:]))
        low = np.empty(len(at), np.int64)
        if len(at):
            low[1:] = at[:-1] + 1
            low[edges] = 0
            size = at - low + 1
            level = np.frexp(size.astype(np.float64))[1] - 1
            value = np.empty(len(at), np.uint8)
            for k in np.unique(level).tolist():
                some = level == k
                value[some] = np.minimum(table[k][low[some]], table[k][at[some] + 1 - (1 << k)])
            heads = symbol[edges]
            value[edges] = np.minimum(value[edges], least[heads])
            value = np.minimum(value, self.cap - 1) + np.uint8(1)
        fresh = np.full(self.symbols, int(common.min()) if len(common) else 255, np.uint8)
        fresh = np.minimum(fresh, least)
        ends = np.append(edges[1:], len(at))[: len(edges)]
        suffix = np.minimum.accumulate(common[::-1])[::-1]
        for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
            s, last = int(symbol[a]), int(at[b - 1])
            queue.push(s, before[a:b].astype(np.int32), value[a:b])
            fresh[s] = suffix[last + 1] if last + 1 < len(common) else 255
        least[:] = fresh

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, each with its common prefix with the one before."""
        if self.n == 1:
            return np.zeros(1, np.int32), np.zeros(1, np.uint8)
        star, common = self.stars()
        symbol = self.t[star]
        edges = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        by_star = {int(symbol[a]): (star[a:b], common[a:b]) for a, b in zip(edges.tolist(), np.append(edges[1:], len(star)).tolist(), strict=True)}
        if 0 not in by_star:  # the end itself begins the ascending scan
            by_star[0] = (np.array([self.n - 1], np.int32), np.zeros(1, np.uint8))
        falling = self._induce(iter(range(self.symbols)), False, by_star)
        down = {s: (p[::-1], np.concatenate([[np.uint8(0)], c[::-1][:-1]])) for s, (p, c) in falling.items()}
        rising = self._induce(iter(range(self.symbols - 1, -1, -1)), True, down)
        places, commons = [np.array([self.n - 1], np.int32)], [np.zeros(1, np.uint8)]
        for s in range(1, self.symbols):
            last = None
            if s in falling:
                p, c = falling[s]
                c = c.copy()
                c[0] = 0
                places.append(p)
                commons.append(c)
                last = p[-1]
            if s in rising:
                p, c = rising[s]
                p, c = p[::-1], np.concatenate([[np.uint8(0)], c[::-1][:-1]])
                if last is not None:
                    c[0] = self.common(np.array([last], np.int64), p[:1].astype(np.int64), np.zeros(1, np.int64))[0]
                places.append(p)
                commons.append(c)
        return np.concatenate(places), np.concatenate(commons)


def repeated(pieces: list[bytes], length: int = LENGTH, limit: int = 2 << 20) -> list[np.ndarray]:
    """For each piece, which of its ``len - length + 1`` starts begin a string that begins elsewhere too."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
    text[starts + sizes] = 1
    text = np.append(text, np.uint16(0))
    places, common = Sorter(text, length, limit).order()
    full = common >= length
    full[:-1] |= common[1:] >= length
    flag = np.zeros(len(text), bool)
    flag[places[full]] = True
    return [flag[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _sort(length: int):
    """Pieces, a key's together -> (rid, start, n): runs of repeated starts of the runs that stand alone.

    Runs are settled once more by classes of offsets: a class whose common bytes occur once has no repeat,
    classes with equal texts repeat each other, and one of each other text goes to the suffix sorter.
    """

    def found(rows: list[tuple]) -> pa.RecordBatch:
        import xxhash

        digest = xxhash.xxh64_intdigest
        key, ctx, where = [], [], []
        for i, (outer, _, _, _, anchor, piece) in enumerate(rows):
            seed = outer & 0xFFFFFFFFFFFFFF00
            for a, k, common in classes(len(piece) - length + 1, anchor):
                key.append(digest(piece[common : common + length - _CLASS + 1], seed ^ (_CLASS + anchor - common)))
                ctx.append(digest(piece[a : a + k + length - 1], anchor - a))
                where.append((i, a, k))
        keys, contexts, where = np.array(key, np.uint64), np.array(ctx, np.uint64), np.array(where, np.int64).reshape(-1, 3)
        order = np.lexsort((contexts, keys))
        keys, contexts, where = keys[order], contexts[order], where[order]
        fresh_key = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        fresh = fresh_key | np.concatenate([[True], contexts[1:] != contexts[:-1]])[: len(keys)]
        of = np.cumsum(fresh) - 1
        many = np.bincount(of) > 1
        first = np.flatnonzero(fresh)
        group = (np.cumsum(fresh_key) - 1)[first]
        contested = (np.bincount(group) > 1)[group]
        out = [(i, a, k) for i, a, k in where[many[of]].tolist()]
        asked = where[first[contested]].tolist()
        single = ~many[contested]
        texts = [rows[i][5][a : a + k + length - 1] for i, a, k in asked]
        total, groups, low = np.cumsum([0, *map(len, texts)]), group[contested].tolist(), 0
        for high in range(1, len(texts) + 1):  # sort a few MB at a time, the texts of a common key together
            if high < len(texts) and (total[high] - total[low] < _BATCH or groups[high] == groups[high - 1]):
                continue
            for (i, a, _), flags, one in zip(asked[low:high], repeated(texts[low:high], length), single[low:high].tolist(), strict=True):
                if one and flags.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                    out += [(i, a + int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2], strict=True)]
            low = high
        out = [(rows[i][2], rows[i][3] + a, k) for i, a, k in out if rows[i][1]]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["rid", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > 4 * _BATCH and row[0] != rows[-1][0]:
                    yield found(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield found(rows)

    return run


# ---- the operator


def _removal(length: int, keep_text: bool):
    def remove(text: pa.Array, spans: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        view, rows = memoryview(data), []
        for a, b, found in zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans.to_pylist(), strict=True):
            body, merged = view[a:b], []
            for x in sorted(found or (), key=lambda x: x["start"]):
                low, high = x["start"], x["start"] + x["n"] + length - 1
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            edges = [0, *[e for m in merged for e in m], b - a]
            kept = b"".join(body[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
            rows.append((b - a, b - a - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if keep_text else b""))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.StructArray.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return F.arrow_udf(remove, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary>").asNondeterministic()


def spans(docs: DataFrame, *, length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """``docs``: (rid, text). (rid, start, n): runs of starts of repeated strings."""
    import uuid

    spark = docs.sparkSession
    runs_of = docs.filter(F.octet_length("text") >= length).mapInArrow(_anchors(length, reach), "key bigint, ctx bigint, rid bigint, place bigint")
    sifted = runs_of.repartition("key").sortWithinPartitions("key", "ctx").mapInArrow(_sift, "kind int, key bigint, rid bigint, place bigint")
    path = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    sifted.write.parquet(path)
    sifted = spark.read.parquet(path)
    settled = sifted.filter(F.col("kind") == _SETTLED).select("rid", F.shiftright("place", 16).alias("start"), F.col("place").bitwiseAND(F.lit(0xFFFF)).alias("n"))
    asked = sifted.filter(F.col("kind") > _SETTLED).groupBy("rid").agg(F.collect_list(F.struct("key", "kind", "place")).alias("asked"))
    pieces = docs.join(asked, "rid").select("rid", "text", "asked").mapInArrow(_pieces(length, reach), _PIECES)
    found = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(length), "rid bigint, start bigint, n bigint")
    return settled.unionByName(found)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, reach: int = REACH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = spans(rows.select("rid", "text"), length=length, reach=reach).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = rows.join(found, "rid", "left")
    return joined.select("doc_id", _removal(length, keep_text)("text", "spans").alias("_r")).select("doc_id", "_r.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False).drop("kept")
