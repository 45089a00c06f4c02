"""Token-id output: ORC stripes of run-length encoded ids, with row indexes and Bloom filters on doc_id.

The texts are dealt out by ranges of doc_id (one shuffle, of texts), encoded in that order and written
as ORC, one file a range: integers are run-length encoded, every 10,000 rows have an index entry, and
every index entry has a Bloom filter on doc_id, so a lookup skips stripes and row groups and a large
file is read stripe by stripe in parallel. The start of a document is the sum of the shards before it
(one row a shard) and of the rows before it in its shard; no window spans the table.

Encoding goes by pieces, cut where the pre-tokenizer always cuts: before the last space or line break of a run that
something visible follows, between that line break and what follows, and between a letter and an ASCII mark or digit. So the ids
of a text are those of its pieces. Pieces of up to 23 bytes and 8 ids are kept in a table of ``2 ** _SLOT_BITS`` places a
worker, 40 bytes each, which all pieces of a stretch are looked up in at once; a place holds the piece's own bytes and
length, so a look-up is exact, and new pieces take the place of others once both of theirs are taken. A small memo has larger pieces. What the table does not know goes to the library:
letters, which are one unit of the pre-tokenizer, straight to its model (those after a space in one call a stretch), all else to the tokenizer.

Null and empty texts have only the end id. Rows with a null doc_id come first; rows that share a
doc_id follow each other in the order of a hash of their texts, and repeated rows each get a row. A very long text is
encoded whole. No rows give no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import threading
import time
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._arrow import chunks, texts, utf8
from tessera.session import arrow_batches, cut, shared_dir

END_ID = 0
#: Places of the table of pieces, as a power of 2.
_SLOT_BITS = 20
#: Ids of a piece that the table takes, and its bytes; the last byte of three words is the length.
_IDS, _BYTES = 8, 23
#: Pieces looked up at once, and bytes of texts encoded at once.
_SLICE, _CHUNK = 1 << 16, 1 << 19
#: Pieces that are kept though the table does not take them, and the most bytes of one.
_LARGE, _LARGE_BYTES = 30_000, 200
#: Documents that a Python worker takes at once.
BATCH = 1_000
#: Seconds after which an idle worker's memo is dropped.
_IDLE_S = 3.0
_SPECIAL = "<|"
_CUTS, _LETTER, _MARK, _LINE, _SEEN = 1, 2, 4, 8, 16
#: What each byte is. Bytes of characters beyond ASCII count as visible; ``_BLANKS`` has those that are not.
_KIND = np.array(
    [
        _CUTS * (b in b" \n") | _LETTER * (b < 128 and chr(b).isalpha()) | _MARK * (32 < b < 127 and not chr(b).isalpha()) | _LINE * (b == 10) | _SEEN * (b >= 128 or not chr(b).isspace())
        for b in range(256)
    ],
    np.uint8,
)
#: First three bytes (for two-byte characters, two and a zero) of white space beyond ASCII.
_BLANKS = np.array([int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in map(chr, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])])
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_places(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin. ``data`` goes on for 3 bytes or more after the texts; ``whole`` texts are one piece."""
    n = int(offsets[-1])
    kind = _KIND[data[: n + 1]]
    here, after = kind[:-1], kind[1:]
    cut = (here & _CUTS > 0) & (after & _SEEN > 0)
    beyond = np.flatnonzero(cut & (data[1 : n + 1] >= 128))
    if len(beyond):
        lead = data[beyond + 1].astype(np.int64)
        code = lead << 16 | data[beyond + 2].astype(np.int64) << 8 | np.where(lead < 0xE0, 0, data[beyond + 3])
        cut[beyond[np.isin(code, _BLANKS)]] = False
    starts, ends = offsets[:-1], offsets[1:]
    some = ends > starts
    last = ends[some] - 1
    cut[last[here[last] & _CUTS > 0]] = False  # a space at the end of a text belongs to the run before it
    cut[np.flatnonzero(cut & (here & _LINE > 0)) + 1] = True
    marks = here[1:] & _MARK > 0
    cut[1:] |= marks & (here[:-1] & _LETTER > 0)
    beyond = np.flatnonzero(marks & (data[: max(n - 1, 0)] >= 128))  # after U+00C0 to U+024F, of which two are signs
    lead, tail = data[beyond - 1], data[beyond]
    cut[beyond[(lead >= 0xC3) & (lead <= 0xC9) & ((lead > 0xC3) | (tail != 0x97) & (tail != 0xB7))] + 1] = True
    for i in np.flatnonzero(whole):
        cut[starts[i] : ends[i]] = False
    cut[starts[some]] = True
    return np.flatnonzero(cut)


def _counted(known: np.ndarray) -> np.ndarray:
    return np.bitwise_count(known.view(np.uint64)[:, 0]).astype(np.int64)


class Table:
    """Piece -> ids, as arrays: three words of a piece's bytes and length, and its ids. Every piece has two places."""

    def __init__(self, filler: int, bits: int) -> None:
        self.shift, self.filler = np.uint64(64 - bits), filler
        self.keys = np.zeros((1 << bits, 3), np.uint64)
        self.ids = np.full((1 << bits, _IDS), filler, np.min_scalar_type(filler))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it holds the piece) of each piece."""
        mixed = keys[:, 0] * _MIX[0] ^ keys[:, 1] * _MIX[1] ^ keys[:, 2] * _MIX[2]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX[3]
        place = (mixed >> self.shift).astype(np.int64)
        held = self.holds(place, keys)
        rest = np.flatnonzero(~held)
        other = place[rest] ^ 1
        found = self.holds(other, keys[rest])
        place[rest[found]], held[rest[found]] = other[found], True
        return place, held

    def holds(self, place: np.ndarray, keys: np.ndarray) -> np.ndarray:
        own = self.keys.take(place, 0)
        return (own[:, 0] == keys[:, 0]) & (own[:, 1] == keys[:, 1]) & (own[:, 2] == keys[:, 2])

    def put(self, place: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
        """Keep new pieces: in an empty place of their two, else in the first, or the second for pieces of odd length."""
        taken = self.keys[place, 2] > 0
        free = self.keys[place ^ 1, 2] == 0
        odd = keys[:, 2] >> np.uint64(56) & np.uint64(1) > 0
        place, kept = np.unique(np.where(taken & (free | odd), place ^ 1, place), return_index=True)
        self.keys[place], self.ids[place] = keys[kept], ids[kept]


class Encoder:
    """Ids of whole texts by the tokenizers library, with a bounded table of pieces."""

    busy = False

    def __init__(self, file: str, bits: int | None = None) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        # The model reads bytes as visible characters: printable ones stand for themselves, the others follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.visible = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self.space = chr(self.visible[32])
        self.units = Tokenizer(self.model)
        self.units.pre_tokenizer = Split(self.space, "merged_with_next")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        largest = max(vocab.values())
        self.begins = np.zeros(largest + 1, bool)
        self.begins[[i for token, i in vocab.items() if token[:1] == self.space]] = True
        self.filler, self.bits = (65_535 if largest < 65_535 else (1 << 32) - 1), _SLOT_BITS if bits is None else bits
        self.table, self.large = None, {}
        self.used = time.monotonic()
        threading.Thread(target=self.watch, daemon=True).start()

    def watch(self) -> None:
        """Drop a table that is not in use: workers outlive their tasks, and others run in them next."""
        while True:
            time.sleep(1)
            if self.table and not self.busy and time.monotonic() - self.used > _IDLE_S:
                self.table, self.large = None, {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def unit(self, text: str) -> bytes:
        """Ids of one unit of the pre-tokenizer."""
        return self.seen(text.encode().decode("latin-1").translate(self.visible))

    def seen(self, text: str) -> bytes:
        """Ids of one unit in visible characters."""
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def learn(self, piece: str) -> bytes:
        """Ids of a piece that follows a space."""
        if piece.isalpha():
            return self.seen(self.space + piece) if piece.isascii() else self.unit(" " + piece)
        return self.plain(" " + piece)

    def fresh(self, piece: bytes) -> np.ndarray:
        """Ids of a piece that the table does not know."""
        ids = self.large.get(piece)
        if ids is None:
            text = piece.decode("utf-8", "replace")
            if text[0] == " ":
                ids = self.learn(text[1:])
            else:
                ids = self.unit(text) if text.isalpha() else self.plain(text)
            self.keep(piece, ids)
        return np.frombuffer(ids, "<u4")

    def keep(self, piece: bytes, ids: bytes) -> None:
        """Keep a piece that the table does not take."""
        if (len(piece) > _BYTES or len(ids) > 4 * _IDS) and len(piece) <= _LARGE_BYTES:
            if len(self.large) >= _LARGE:
                self.large.clear()
            self.large[piece] = ids

    def spaced(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of pieces that are a space and letters: each is one unit, whose first id alone begins with the space."""
        text = b"".join(pieces)
        text = text.decode().replace(" ", self.space) if text.isascii() else text.decode("latin-1").translate(self.visible)
        ids = np.array(self.units.encode_batch_fast([text], add_special_tokens=False)[0].ids if pieces else [], "<u4")
        return ids, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids)).astype(np.int64)

    def pieces(self, data: np.ndarray, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of each). ``data`` goes on for 24 bytes or more after the last start."""
        table = self.table = self.table or Table(self.filler, self.bits)
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        fits = sizes <= _BYTES
        keys = np.empty((len(starts), 3), np.uint64)
        for i in range(3):
            keys[:, i] = words[starts + 8 * i] & _LOW[np.clip(sizes - 8 * i, 0, 8)]
        keys[:, 2] |= sizes.astype(np.uint64) << np.uint64(56)
        keys[~fits] = 0
        place, held = table.find(keys)
        held &= fits
        rows = table.ids.take(place, 0)
        rows[~held] = table.filler
        new = np.flatnonzero(~held)
        if not len(new):
            known = rows != table.filler
            return rows[known].astype("<u4"), _counted(known)
        spaced, other, codes, first = {}, {}, [], []
        for i, (a, n) in enumerate(zip(starts[new].tolist(), sizes[new].tolist(), strict=True)):
            piece = raw[a : a + n]
            code = spaced.get(piece)
            if code is None and (code := other.get(piece)) is None:
                first.append(i)
                letters = piece[1:]
                if piece[0] == 32 and piece not in self.large and (letters.isalpha() or not letters.isascii() and letters.decode().isalpha()):
                    code = spaced[piece] = len(spaced)
                else:
                    code = other[piece] = -1 - len(other)
            codes.append(code)
        flat, counts = self.spaced(list(spaced))
        names, ends = list(spaced), np.cumsum(counts)
        for i in np.flatnonzero((counts > _IDS) | (np.fromiter(map(len, names), np.int64, len(names)) > _BYTES)).tolist():
            self.keep(names[i], flat[ends[i] - counts[i] : ends[i]].tobytes())
        rest = [self.fresh(piece) for piece in other]
        flat, counts = np.concatenate([flat, *rest]), np.concatenate([counts, np.array([len(x) for x in rest], np.int64)])
        codes, first = np.array(codes), np.array(first)
        codes[codes < 0] = len(spaced) - 1 - codes[codes < 0]
        small = counts <= _IDS
        filled = np.full((len(counts), _IDS), table.filler, rows.dtype)
        filled[np.arange(_IDS) < np.where(small, counts, 0)[:, None]] = flat[np.repeat(small, counts)]
        rows[new] = filled[codes]
        kept = first[fits[new[first]] & small[codes[first]]]
        table.put(place[new[kept]], keys[new[kept]], filled[codes[kept]])
        known = rows != table.filler
        sums = _counted(known)
        if small.all():
            return rows[known].astype("<u4"), sums
        ends, at = np.cumsum(counts), np.flatnonzero(~small[codes])
        sums[new[at]] = counts[codes[at]]
        long = np.zeros(len(starts), bool)
        long[new[at]] = True
        long, ids = np.repeat(long, sums), np.empty(int(sums.sum()), "<u4")
        ids[~long], ids[long] = rows[known], np.concatenate([flat[ends[c] - counts[c] : ends[c]] for c in codes[at].tolist()])
        return ids, sums

    def encode(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each), with ``end_id`` after every text."""
        self.busy = True
        try:
            data, offsets = utf8(text)
            data = np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(32, np.uint8)])
            offsets, raw = offsets - offsets[0], data.tobytes()
            starts = cut_places(data, offsets, pc.match_substring(text, _SPECIAL).to_numpy(zero_copy_only=False))
            sizes = np.diff(starts, append=offsets[-1])
            parts = [self.pieces(data, raw, starts[i : i + _SLICE], sizes[i : i + _SLICE]) for i in range(0, len(starts), _SLICE)]
            ids = np.concatenate([np.zeros(0, "<u4"), *[p[0] for p in parts]])
            before = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]]))])
            bounds = before[np.searchsorted(starts, offsets)]
            return np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1
        finally:
            self.busy, self.used = False, time.monotonic()


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    return Encoder(file)


def valid(text: pa.Array) -> pa.Array:
    """Without nulls, and with the replacement character for what is not UTF-8."""
    text = text.fill_null("") if text.null_count else text
    try:
        text.validate(full=True)
    except pa.ArrowInvalid:
        text = pa.array([t.decode("utf-8", "replace") for t in texts(text)], text.type)
    return text


def encode_udf(file: str, end_id: int = END_ID):
    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        coder, ids, sizes = encoder(file), [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        text = valid(text)
        _, offsets = utf8(text)
        for i, j in chunks(offsets, _CHUNK):
            found, each = coder.encode(text.slice(i, j - i), end_id)
            ids.append(found)
            sizes.append(each)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(ids).view("<i4"), pa.int32()))

    return encode.asNondeterministic()


def write_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", file: str | None = None, end_id: int = END_ID, shards: int | None = None, row_group: int = 10_000, stripe_bytes: int = 64 << 20) -> None:
    """Encode ``docs`` and write (shard, row, doc_id, ids) in ascending doc_id order as ORC at ``path``."""
    spark = docs.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs._jdf.rdd().getNumPartitions())  # grows with the input's splits
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    encode = encode_udf(file or tokenizer_file(), end_id)
    out = dealt.select("doc_id", encode("text").alias("ids"))
    out = out.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "doc_id", "ids")
    with arrow_batches(spark, BATCH):
        (
            out.write.format("orc").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
            .option("orc.row.index.stride", str(row_group)).option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").save(path)
        )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, row, doc_id, ids). Filters on doc_id reach the ORC reader, which prunes by stripe, row group and Bloom filter."""
    return spark.read.schema("shard int, row bigint, doc_id bigint, ids array<int>").orc(path)


def _summary(ids: pa.Array) -> pa.Array:
    values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
    offsets = ids.offsets.to_numpy()
    view = memoryview(values).cast("B")
    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    rows = read_tokens(spark, path).select("shard", "row", "doc_id", F.arrow_udf(_summary, "struct<n_tokens:bigint,ids_crc32:bigint>").asNondeterministic()("ids").alias("_s")).select("shard", "row", "doc_id", "_s.*")
    with arrow_batches(spark, BATCH):
        rows = cut(rows)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))  # a row a shard
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("_within", within).join(before, "shard").select("doc_id", (F.col("_before") + F.col("_within")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tokenised(docs: DataFrame, **options) -> DataFrame:
    """Write the ids to a new folder of the shared one, read the files back and index them."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    write_tokens(docs, path, **options)
    return token_index(spark, path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"))
