"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power tau, normalised. Tau falls from 1 (natural shares)
towards 0 (equal shares) and is bisected until the weights' entropy has closed ``closing`` of the gap between
the natural shares' entropy and the most possible (or has reached ``target`` of the most possible, where that is
given); if then some source would be repeated more than ``max_repeats`` times within the budget, tau is
bisected upwards until none is.

The weights are realised as budgeted block permutations. Documents are dealt to blocks of their source
by a hash. A source's token budget is a number of full passes and a rest. Each pass has its own order of
blocks, and documents follow each other within a block by their hash: ``position`` numbers the documents of
a source in that order. The rest is one more, partial pass: whole blocks in their order, then documents of
one more block, up to the budget and never beyond it.

Sizes per source come to the driver, at most ``MAX_SOURCES`` of them. Narrow rows (no texts) are numbered
within blocks by one window over (source, block); a hot source has more blocks, never one task. What each
pass takes of a block is a table of at most ``MAX_BLOCKS`` rows a source and pass, broadcast while its counted
rows are few, else joined. So texts are not shuffled.

Tokens are words without ASCII white space unless a column is named; null and empty texts have none, and a very
long text is one document like any other. Documents without tokens are in every full pass and in the rest if
their place is. A null source is the source ''; a null doc_id is a document of its own. Repeated rows each
count, share their places' hash and are taken or left together. Ties of the hash go by tokens. No rows give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._rows import packed
from tessera.llm.quality import words_of
from tessera.session import cut

CLOSING, MAX_REPEATS, SEED = 0.5, 4.0, 7
BLOCK_DOCS, MAX_BLOCKS, BROADCAST_ROWS, MAX_SOURCES = 500, 4096, 200_000, 100_000


def weights(tokens: dict[str, int], tau: float) -> dict[str, float]:
    total = sum(tokens.values())
    raised = {k: (n / total) ** tau if n else 0.0 for k, n in tokens.items()}
    whole = sum(raised[k] for k in sorted(raised))
    return {k: x / whole for k, x in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for _, p in sorted(shares.items()) if p > 0)


def repeats(tokens: dict[str, int], shares: dict[str, float], budget: int) -> float:
    return max((shares[k] * budget / n for k, n in tokens.items() if n), default=0.0)


def bisect(good, low: float, high: float, steps: int = 60) -> float:
    """The point where ``good`` begins to hold, from ``low`` (it does not) to ``high`` (it does)."""
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def temperature(tokens: dict[str, int], budget: int, *, closing: float = CLOSING, target: float | None = None, max_repeats: float = MAX_REPEATS) -> float:
    some = sum(1 for n in tokens.values() if n)
    natural, most = entropy(weights(tokens, 1.0)), math.log(some) if some else 0.0
    aim = natural + closing * (most - natural) if target is None else target * most
    tau = 1.0
    if natural < aim - 1e-12:
        tau = 1 - bisect(lambda x: entropy(weights(tokens, 1 - x)) >= aim, 0.0, 1.0)
    if repeats(tokens, weights(tokens, tau), budget) > max_repeats:
        if repeats(tokens, weights(tokens, 1.0), budget) > max_repeats:
            raise ValueError("the budget itself repeats every source more often than max_repeats")
        tau = bisect(lambda x: repeats(tokens, weights(tokens, x), budget) <= max_repeats, tau, 1.0)
    return tau


@dataclass(frozen=True)
class Share:
    source: str
    docs: int
    tokens: int
    weight: float
    budget: int
    passes: int
    rest: int
    blocks: int


def plan(sizes: dict[str, tuple[int, int]], *, budget: int | None = None, block_docs: int = BLOCK_DOCS, **options) -> list[Share]:
    """What each source gives. ``sizes``: source -> (documents, tokens); the budget is all tokens unless given."""
    tokens = {k: n for k, (_, n) in sizes.items()}
    total = sum(tokens.values())
    budget = total if budget is None else budget
    shares = weights(tokens, temperature(tokens, budget, **options)) if total else dict.fromkeys(tokens, 0.0)
    out = []
    for k, (docs, n) in sorted(sizes.items()):
        mine = round(shares[k] * budget)
        passes, rest = divmod(mine, n) if n else (1, 0)
        out.append(Share(k, docs, n, shares[k], mine, passes, rest, min(MAX_BLOCKS, max(1, -(-docs // block_docs)))))
    return out


def _hash(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws(":", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts]).cast("binary"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _few(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if its rows are few enough."""
    table = cut(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def mixture(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokens: str | None = None, seed: int = SEED, into: DataFrame | None = None, **options) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, position), a row for each time a document is taken.

    ``position`` is the document's place, from 0, in its source's order of that epoch. With ``into`` (the same
    documents, with other columns) its rows are returned instead, as often as they are taken.
    """
    spark = docs.sparkSession

    def sized(frame: DataFrame) -> DataFrame:
        held = packed(frame)
        at = lambda name: F.col(f"row.`{name}`")  # noqa: E731
        n = at(tokens).cast("long") if tokens else F.size(words_of(F.coalesce(at(text), F.lit("")))).cast("long")
        mark = _hash(seed, F.coalesce(at(doc_id).cast("string"), F.lit("")))
        return held.withColumns({"doc_id": at(doc_id), "source": F.coalesce(at(source), F.lit("")), "n_tokens": F.coalesce(n, F.lit(0).cast("long")), "mark": mark})

    rows = cut(sized(docs).drop("row"))
    counted = cut(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")))
    if (found := counted.count()) > MAX_SOURCES:
        raise ValueError(f"{found} sources; at most {MAX_SOURCES} can be weighed at once")
    shares = plan({r["source"]: (r["n"], r["t"]) for r in counted.collect()}, **options)
    by_source = F.broadcast(spark.createDataFrame([(s.source, s.passes, s.rest, s.blocks) for s in shares], "source string, passes long, rest long, blocks long"))  # MAX_SOURCES rows at most

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.join(by_source, "source").withColumn("block", F.pmod(_number(F.col("mark")), F.col("blocks")))

    within = Window.partitionBy("source", "block").orderBy("mark", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt(rows).withColumn("place", F.count("*").over(within) - 1).withColumn("run", F.sum("n_tokens").over(within))
    blocks = dealt(rows).groupBy("source", "block", "passes", "rest").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    order = Window.partitionBy("source", "epoch").orderBy(_hash(seed, F.col("source"), F.col("epoch"), F.col("block")), "block")
    before = blocks.withColumn("first", F.sum("n").over(order) - F.col("n")).withColumn("room", F.when(F.col("epoch") == F.col("passes"), F.col("rest") - F.sum("t").over(order) + F.col("t")))
    before = cut(before.filter(F.coalesce(F.col("room") > 0, F.lit(True))))
    # The one block a source that is taken in part, up to the first document that does not fit.
    part = before.filter(F.col("t") > F.col("room")).select("source", "block", "room")
    stops = placed.join(F.broadcast(part), ["source", "block"]).filter(F.col("run") > F.col("room")).groupBy("source", "block").agg(F.min(F.struct("mark", "n_tokens")).alias("stop"))
    taken = before.select("source", "block", "epoch", "passes", "first").join(stops, ["source", "block"], "left")
    taken = _few(taken.select("source", "block", "epoch", "first", F.when(F.col("epoch") == F.col("passes"), F.col("stop")).alias("stop")))
    met = (placed if into is None else dealt(sized(into))).select("source", "block", "mark", "n_tokens", *(["doc_id", "place"] if into is None else ["row"])).join(taken, ["source", "block"])
    met = met.filter(F.col("stop").isNull() | (F.struct("mark", "n_tokens") < F.col("stop")))
    if into is not None:
        return met.select("row.*")
    return met.select("doc_id", "source", "n_tokens", "epoch", "block", (F.col("first") + F.col("place")).alias("position"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _bisected(name: str, low: str, test: str, start: str) -> str:
    """SQL of :func:`bisect` in 60 steps: ``test`` is over tau ``x``, with w the raised shares and z their sum; ``low`` and ``start`` give the first ends."""
    return f"""{name}(step, low, high) AS (SELECT 0, {low}, 1.0::DOUBLE {start} UNION ALL SELECT step + 1, CASE WHEN good THEN low ELSE m END, CASE WHEN good THEN m ELSE high END
  FROM (SELECT step, low, high, m, {test} AS good FROM (SELECT *, list_sum(w) AS z FROM (SELECT *, list_transform(t, lambda n: pow(n / total, x)) AS w FROM (SELECT *, {'1 - m' if name == 'b' else 'm'} AS x FROM (SELECT {name}.*, (low + high) / 2 AS m, l.* FROM {name}, l WHERE step < 60))))))"""


_ENTROPY = "ln(z) - list_sum(list_transform(w, lambda v: v * ln(v))) / z"
_REPEATS = "list_max(list_transform(t, lambda n: pow(n / total, x - 1))) / z"
OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens,
       md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
s AS (SELECT source, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
l0 AS (SELECT list(CAST(tokens AS DOUBLE) ORDER BY source) AS t, CAST(sum(tokens) AS DOUBLE) AS total FROM s WHERE tokens > 0),
l AS (SELECT t, total, h + {CLOSING} * (ln(len(t)) - h) AS aim, h < h + {CLOSING} * (ln(len(t)) - h) - 1e-12 AS uneven FROM (SELECT *, -list_sum(list_transform(t, lambda n: n / total * ln(n / total))) AS h FROM l0)),
{_bisected('b', '0.0::DOUBLE', f'{_ENTROPY} >= aim', '')},
tau AS (SELECT CASE WHEN uneven THEN 1 - high ELSE 1.0 END AS x FROM b, l WHERE step = 60),
c0 AS (SELECT *, list_sum(list_transform(t, lambda n: pow(n / total, x))) AS z FROM tau, l),
{_bisected('c', 'x', f'{_REPEATS} <= {MAX_REPEATS}', 'FROM tau')},
e AS (SELECT CASE WHEN {_REPEATS} > {MAX_REPEATS} THEN high ELSE x END AS x, t, total FROM c, c0 WHERE step = 60),
p AS (SELECT source, docs, tokens, least({MAX_BLOCKS}, greatest(1, CAST(ceil(docs / {float(BLOCK_DOCS)}) AS BIGINT))) AS blocks,
       CASE WHEN tokens > 0 THEN CAST(round_even(pow(tokens / total, x) / list_sum(list_transform(t, lambda n: pow(n / total, x))) * total, 0) AS BIGINT) END AS mine FROM s LEFT JOIN e ON true),
q AS (SELECT *, CASE WHEN tokens > 0 THEN mine // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN mine % tokens ELSE 0 END AS rest FROM p),
g AS (SELECT d.*, passes, rest, ('0x' || substr(mark, 1, 8))::BIGINT % blocks AS block FROM d JOIN q USING (source)),
r AS (SELECT *, row_number() OVER o - 1 AS place, sum(n_tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS run FROM g WINDOW o AS (PARTITION BY source, block ORDER BY mark, n_tokens)),
k AS (SELECT *, sum(n) OVER o - n AS first, CASE WHEN epoch = passes THEN rest - sum(t) OVER o + t END AS room
      FROM (SELECT source, block, passes, rest, sum(n_tokens) AS t, count(*) AS n, unnest(range(passes + 1)) AS epoch FROM g GROUP BY source, block, passes, rest)
      WINDOW o AS (PARTITION BY source, epoch ORDER BY md5(concat_ws(':', '{SEED}', source, epoch, block)), block)),
y AS (SELECT k.*, (SELECT min((mark, n_tokens)) FROM r WHERE r.source = k.source AND r.block = k.block AND run > room) AS stop FROM k WHERE coalesce(room > 0, true))
SELECT doc_id, source, n_tokens, epoch, block, CAST(first + place AS BIGINT) AS position FROM r JOIN y USING (source, block) WHERE stop IS NULL OR (mark, n_tokens) < stop
"""
