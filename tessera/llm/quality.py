"""Host-level quality rules, in DataFrame functions only.

Each document gets its base measures and a flag for each rule: too few words, too many repeated words, too many
symbols, too many lines that repeat. The first two fail a document by themselves. Failures of every rule are summed
by host (partial sums, so a hot host is no burden); each rule has a beta prior of its own, fitted to the hosts' rates
by the method of moments, and shrinks every host's rate towards that rule's mean. A host whose shrunk rate passes
``host_limit`` for any rule is rejected with all its documents. The host verdicts are joined back to the checkpointed
measures.

Words are maximal runs without ASCII white space. A null or empty text has no words and fails; a very long text is one
row like any other. A document with a null host is judged by its base rules alone. A rate that ties with the limit
passes. Repeated rows each count and each get a row; columns of the input other than the three named are not read, so
their names cannot clash. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
HOST_LIMIT = 0.6
#: Symbols to 100 characters of words, and repeated lines to 100 lines, above which a document fails these rules.
SYMBOL_PERCENT, LINE_PERCENT = 10, 30
RULES = ("few_words", "repeats", "symbols", "dup_lines")
_SPACE = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that are found twice or more, the first included."""

    def covered(at: Column) -> Column:  # ascending starts: each window adds what the next one doesn't
        steps = F.transform(at, lambda p, i: F.coalesce(F.least(F.try_element_at(at, i + F.lit(2)) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(pairs: Column) -> Column:  # windows sorted by hash: those that equal a neighbour
        hit = lambda x, i: (i > 0) & (F.get(pairs, i - 1)["h"] == x["h"]) | (i < F.size(pairs) - 1) & (F.get(pairs, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(pairs, hit), lambda x: x["p"]))

    def found(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, places), covered))

    def hashes(single: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(single) - (width - 1)), lambda i: F.xxhash64(F.slice(single, i, width)))

    inner = let(F.transform(words, lambda w: F.xxhash64(w)), lambda single: let(hashes(single), found))
    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(inner)


def measures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the base measures of every document; one narrow pass."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), body.alias("body"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = rows.select(
        "doc_id", "host", let(words_of(F.col("body")), of_words).alias("w"),
        F.char_length(F.regexp_replace("body", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), line_counts.alias("l"),
    )
    rows = rows.select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")
    failed = {
        "few_words": F.col("n_words") < MIN_WORDS, "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"), "dup_lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
    }
    return rows.withColumns(failed | {"base_failed": failed["few_words"] | failed["repeats"]})


def host_verdicts(measured: DataFrame, *, host_limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, rates (rule -> shrunk rate), host_failed (the rules it fails), host_rejected. A prior has the mean and the between-host variance of its rule's raw rates."""
    hosts = measured.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(r).alias(r) for r in RULES])
    # One row: sums over hosts, combined in each partition first.
    seen = hosts.agg(F.sum("n").alias("n"), F.avg(1 / F.col("n")).alias("inv"), *[x for r in RULES for x in (F.sum(r).alias(f"f_{r}"), F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}"))]).first()

    def shrunk(rule: str) -> Column:
        mean = seen[f"f_{rule}"] / seen["n"] if seen["n"] else 0.5
        spread = mean * (1 - mean)
        between = max((seen[f"v_{rule}"] or 0.0) - spread * (seen["inv"] or 0.0), 1e-6)
        strength = min(max(spread / between - 1, 1.0), 1000.0) if spread > 0 else 1.0
        return (F.col(rule) + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))

    rates = F.create_map(*[x for r in RULES for x in (F.lit(r), shrunk(r))])
    out = hosts.select("host", "n", rates.alias("rates"))
    failed = F.filter(F.array(*[F.lit(r) for r in RULES]), lambda r: F.element_at("rates", r) > host_limit)
    return out.withColumn("host_failed", failed).withColumn("host_rejected", F.size("host_failed") > 0)


def judge(docs: DataFrame, *, host_limit: float = HOST_LIMIT, **columns: str) -> DataFrame:
    """The measures and rule flags of every document, its host's shrunk rates and failed rules, and ``kept``."""
    measured = cut(measures(docs, **columns))
    verdicts = host_verdicts(measured, host_limit=host_limit).select("host", "rates", "host_failed", "host_rejected")
    joined = measured.join(verdicts, "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
win AS (SELECT rid, p, array_to_string(ws[p : p + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, CAST(sum(least(8, coalesce(nxt - p, 8))) AS BIGINT) AS n FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM rep) GROUP BY rid),
m AS (SELECT d.doc_id, d.source AS host, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars, CAST(w.n_symbols AS BIGINT) AS n_symbols,
             CAST(len(w.ls) AS BIGINT) AS n_lines, CAST(len(w.ls) - len(list_distinct(w.ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
u AS (SELECT host, unnest([{'r': 1, 'x': n_words < 20}, {'r': 2, 'x': 100 * n_repeat_words > 30 * n_words}, {'r': 3, 'x': 100 * n_symbols > 10 * word_chars}, {'r': 4, 'x': 100 * n_dup_lines > 30 * n_lines}]) AS q FROM f WHERE host IS NOT NULL),
h AS (SELECT host, q.r AS rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(q.x AS INT)) AS DOUBLE) AS failed FROM u GROUP BY host, q.r),
s AS (SELECT rule, sum(failed) / sum(n) AS mu, coalesce(var_pop(failed / n), 0) AS v, avg(1 / n) AS inv FROM h GROUP BY rule),
b AS (SELECT rule, mu, CASE WHEN mu * (1 - mu) > 0 THEN least(greatest(mu * (1 - mu) / greatest(v - mu * (1 - mu) * inv, 1e-6) - 1, 1.0), 1000.0) ELSE 1.0 END AS k FROM s),
r AS (SELECT host, bool_or((failed + k * mu) / (n + k) > 0.6) AS bad FROM h JOIN b USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM f LEFT JOIN r USING (host)
"""
