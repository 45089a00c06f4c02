"""Secret scans: Aho-Corasick keywords, anchored expressions at their hits, then embedded checksums.

One automaton holds the key words of every kind and all four-digit hexadecimal strings (a long
hexadecimal run cannot avoid them). Only where the automaton reports a hit is a regular expression
tried, anchored at the hit. Kinds whose format embeds a checksum are kept only if it is right.

Base kinds (matches that are too short still use up their text, then they are dropped):
``assign``, ``access``, ``hex``. Kinds with a checksum, added by the method: ``github`` and ``npm``
(30 characters and their CRC-32 in six base-62 digits), ``xprv`` (base-58 with a double SHA-256).

Null and empty texts have no spans. Offsets are code points, the end is exclusive. Spans of several kinds may
begin at one place; they are listed in the order of ``KINDS``. A very long text is scanned whole in one pass. Repeated
rows each get a row, and no rows give none. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import LOWER, texts

KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE = KINDS[:3]
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_GITHUB = re.compile(rb"gh[oprsu]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    value, out = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit : digit + 1] + out
    return out


def base58_ok(word: bytes) -> bool:
    value = 0
    for c in word:
        value = value * 58 + _BASE58.index(c)
    raw = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: kind -> (anchored expression, test of a match)
RULES = {
    "assign": (_ASSIGN, lambda m: m.end(2) - m.start(2) >= 12),
    "access": (_ACCESS, lambda m: m.end() - m.start() >= 18),
    "hex": (_HEX, lambda m: m.end() - m.start() >= 16),
    "github": (_GITHUB, lambda m: base62_crc(m[1]) == m[2]),
    "npm": (_NPM, lambda m: base62_crc(m[1]) == m[2]),
    "xprv": (_XPRV, lambda m: base58_ok(m[0])),
}
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "gho_": "github", "ghp_": "github", "ghr_": "github", "ghs_": "github", "ghu_": "github", "npm_": "npm", "xprv": "xprv",
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for i in range(1 << 16):
        found.add_word(f"{i:04x}", (4, "hex"))
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def find(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of each secret, in bytes, by start and then kind."""
    # One character a byte, so that the automaton's positions are byte positions.
    hits: dict[str, list[int]] = {}
    for end, (size, kind) in automaton().iter(text.translate(LOWER).decode("latin-1")):
        hits.setdefault(kind, []).append(end - size + 1)
    out = []
    for kind, starts in hits.items():
        pattern, good = RULES[kind]
        after, floor = 0, kind == "hex"
        for start in sorted(starts):
            if start < after:
                continue
            m = pattern.match(text, start)
            if floor and not m:  # capitals look like a hit to the automaton; the run may begin later in it
                m = pattern.search(text, start, start + 4)
                m = m and pattern.match(text, m.start())
            if not m:
                continue
            after = m.end()
            if good(m):
                out.append((m.start(), m.end(), KINDS.index(kind)))
    return sorted(out, key=lambda x: (x[0], x[2]))


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii() or not spans:
        return spans
    at = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    place = lambda i: int(at[i - 1]) if i else 0
    return [(place(a), place(b), k) for a, b, k in spans]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


_RESULT = "struct<kinds:array<string>,starts:array<bigint>,ends:array<bigint>,spans:string,base:string>"


def _scan(text: pa.Array) -> pa.Array:
    rows = [code_points(t, find(t)) for t in texts(text)]
    return pa.StructArray.from_arrays(
        [
            pa.array([[KINDS[k] for _, _, k in r] for r in rows], pa.list_(pa.string())),
            pa.array([[a for a, _, _ in r] for r in rows], pa.list_(pa.int64())),
            pa.array([[b for _, b, _ in r] for r in rows], pa.list_(pa.int64())),
            pa.array([listed(r) for r in rows], pa.string()),
            pa.array([listed([x for x in r if x[2] < len(BASE)]) for r in rows], pa.string()),
        ],
        names=["kinds", "starts", "ends", "spans", "base"],
    )


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and every secret: kinds, starts, ends (parallel arrays), spans and base (listed as text). No shuffle."""
    scan = F.arrow_udf(_scan, _RESULT).asNondeterministic()
    return docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text)).alias("_r")).select("doc_id", "_r.*")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("kinds", lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))
