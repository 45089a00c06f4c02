"""Registered queries over the driver's tables, and their SQL.

The operators are bound to the tables by column parameters: lineitem rows are the records (line number as the ordinal
scale, so 7 is out of range; part as the condition; return flag as the category), orders the sampling pool, md5-derived
numbers the scores and draws.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.portable import uniform_int
from tessera.operators import audit, bootstrap, captions, colour, curve, dedup, labels, metrics, probe, records, reports, sampling, splits, tone
from tessera.session import cut, spread

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _FOUND[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ri(n: int | str, *parts: str) -> str:
    """SQL of :func:`uniform_int`; parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 8))::BIGINT % {n})"


# ---- Part I: records

REC = """r AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS INT) AS fitzpatrick, CAST(l_partkey AS VARCHAR) AS condition, lower(trim(l_returnflag)) AS category, lower(trim(l_linestatus)) AS status,
 CASE WHEN l_linenumber IN (1, 2, 3) THEN 'lighter' ELSE 'darker' END AS band FROM lineitem WHERE l_linenumber BETWEEN 1 AND 6 AND l_orderkey % 97 <> 0)"""
COUNTS = """c AS (SELECT condition, count(*) FILTER (WHERE band = 'lighter') AS lighter, count(*) FILTER (WHERE band = 'darker') AS darker FROM r GROUP BY condition),
 k AS (SELECT *, CASE WHEN darker > 0 THEN lighter::DOUBLE / darker END AS ratio FROM c)"""


def recs(spark: SparkSession, sf_dir: str, category: str = "l_returnflag") -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").withColumn("qc", F.when(F.col("l_orderkey") % 97 == 0, " Wrong ").otherwise(""))
    return records.clean(raw, scale="l_linenumber", condition="l_partkey", category=category, qc="qc")


@query(f"WITH {REC} SELECT l_orderkey, l_partkey, fitzpatrick, condition, category, band FROM r")
def clean_records(spark, d):
    return recs(spark, d).select("l_orderkey", "l_partkey", "fitzpatrick", "condition", "category", "band")


@query(f"WITH {REC} SELECT (SELECT count(*) FROM lineitem) AS n_raw, (SELECT count(*) FROM r) AS n_kept, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM r) AS n_removed")
def record_bookkeeping(spark, d):
    return records.bookkeeping(table(spark, d, "lineitem"), recs(spark, d))


@query(f"WITH {REC}, g AS (SELECT fitzpatrick, count(*) AS n FROM r GROUP BY 1), f AS (SELECT CAST(x AS INT) AS fitzpatrick, coalesce(n, 0) AS n FROM range(1, 7) t(x) LEFT JOIN g ON g.fitzpatrick = x) SELECT fitzpatrick, CAST(n AS BIGINT) AS n, round_even(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS percent FROM f")
def representation(spark, d):
    return audit.representation(recs(spark, d))


@query(f"WITH {REC} SELECT band, count(*) AS n FROM r GROUP BY band")
def band_counts(spark, d):
    return audit.band_counts(recs(spark, d))


@query(f"WITH {REC}, {COUNTS} SELECT condition, lighter, darker, ratio FROM k")
def per_condition_counts(spark, d):
    return audit.per_condition_counts(recs(spark, d))


@query(f"""WITH {REC}, {COUNTS} SELECT count(*) AS n_conditions,
 count(*) FILTER (WHERE lighter >= 20) AS adequate_lighter, round_even(count(*) FILTER (WHERE lighter >= 20) * 100.0::DOUBLE / count(*), 1) AS adequate_percent_lighter, CAST(median(lighter) AS DOUBLE) AS median_all_lighter, CAST(median(lighter) FILTER (WHERE lighter >= 20) AS DOUBLE) AS median_adequate_lighter,
 count(*) FILTER (WHERE darker >= 20) AS adequate_darker, round_even(count(*) FILTER (WHERE darker >= 20) * 100.0::DOUBLE / count(*), 1) AS adequate_percent_darker, CAST(median(darker) AS DOUBLE) AS median_all_darker, CAST(median(darker) FILTER (WHERE darker >= 20) AS DOUBLE) AS median_adequate_darker,
 round(median(ratio) FILTER (WHERE lighter > 0 AND darker > 0), 6) AS median_ratio, round(quantile_cont(ratio, 0.25) FILTER (WHERE lighter > 0 AND darker > 0), 6) AS ratio_q1, round(quantile_cont(ratio, 0.75) FILTER (WHERE lighter > 0 AND darker > 0), 6) AS ratio_q3,
 round_even(count(*) FILTER (WHERE lighter > darker AND darker > 0) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE lighter > 0 AND darker > 0), 0), 1) AS percent_more_lighter FROM k""")
def coverage_summary(spark, d):
    return rounded(audit.coverage_summary(audit.per_condition_counts(recs(spark, d))))


def _chi_sql(category: str) -> str:
    return f"""WITH {REC}, t AS (SELECT band, {category} AS cat, count(*) AS n FROM r GROUP BY ALL), rr AS (SELECT band, sum(n) AS r FROM t GROUP BY 1), cc AS (SELECT cat, sum(n) AS c FROM t GROUP BY 1),
 x AS (SELECT coalesce(n, 0)::DOUBLE AS n, (r * c)::DOUBLE / (SELECT sum(n) FROM t) AS e FROM rr CROSS JOIN cc LEFT JOIN t USING (band, cat)), s AS (SELECT (SELECT count(*) FROM rr) AS nr, (SELECT count(*) FROM cc) AS nc, (SELECT sum(n)::BIGINT FROM t) AS n),
 q AS (SELECT sum(pow(CASE WHEN (nr - 1) * (nc - 1) = 1 THEN abs(x.n - e) - least(0.5, abs(x.n - e)) ELSE abs(x.n - e) END, 2) / e) AS chi2 FROM x, s)
 SELECT round(chi2, 6) AS chi2, (nr - 1) * (nc - 1) AS dof, round(CASE (nr - 1) * (nc - 1) WHEN 2 THEN exp(-chi2 / 2) WHEN 1 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda i: pow(-1, i) * pow(sqrt(chi2 / 2), 2 * i + 1) / (gamma(i + 1) * (2 * i + 1)))) END, 6) AS p, n, round(sqrt(chi2 / nullif(n * (least(nr, nc) - 1), 0)), 6) AS cramers_v FROM q, s"""


@query(f"WITH {REC} SELECT band, category, count(*) AS n FROM r GROUP BY ALL")
def contingency(spark, d):
    return audit.contingency(recs(spark, d))


@query(_chi_sql("category"))
def category_association(spark, d):
    return rounded(audit.category_association(recs(spark, d)))


@query(_chi_sql("status"))
def category_association_yates(spark, d):
    return rounded(audit.category_association(recs(spark, d, "l_linestatus")))


@query(f"""WITH {REC}, p AS (SELECT fitzpatrick::DOUBLE AS x, avg((category = 'r')::INT) * 100 AS y FROM r GROUP BY 1), f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, count(*) AS k FROM p), g AS (SELECT *, sqrt((1 - r * r) * syy / (sxx * (k - 2))) AS se FROM f), h AS (SELECT *, pow(slope / se, 2) AS q FROM g)
 SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, round(se, 6) AS stderr, k, round(slope - 2.7764451051977987 * se, 6) AS low, round(slope + 2.7764451051977987 * se, 6) AS high, round(1 - 0.75 * sqrt(q / (1 + q / 4)) * (1 - q / (1 + q / 4) / 12), 6) AS p FROM h""")  # of six levels, so four degrees of freedom
def malignant_trend(spark, d):
    return rounded(audit.malignant_trend(recs(spark, d), positive="r"))


@query(f"""WITH {REC}, {COUNTS}, h AS (SELECT least(greatest(ratio, 0.0), 10.0) AS r FROM k WHERE lighter > 0 AND darker > 0), e AS (SELECT min(r) AS lo, max(r) AS hi FROM h)
 SELECT CAST(coalesce(least(floor((r - lo) * 28 / nullif(hi - lo, 0)), 27), 0) AS BIGINT) AS bin, count(*) AS n FROM h, e GROUP BY 1""")
def ratio_histogram(spark, d):
    return audit.ratio_histogram(audit.per_condition_counts(recs(spark, d)))


# ---- learning curve

ANCHOR_SQL = "a(n, f) AS (VALUES " + ", ".join(f"({n}, {f}::DOUBLE)" for n, f in curve.ANCHORS) + ")"


def _anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(curve.ANCHORS), "n int, f double")


@query(f"WITH {ANCHOR_SQL} SELECT n, round(0.72 * (1 - exp(-n / 27.8::DOUBLE)), 6) AS exponential, round(0.75 - 2.0 * pow(n, -0.6::DOUBLE), 6) AS power FROM a")
def curve_eval(spark, d):
    n, lit = F.col("n").cast("double"), F.lit
    return rounded(_anchors(spark).select("n", curve.saturating(n, lit(0.72), lit(27.8)).alias("exponential"), curve.inverse_power(n, lit(0.75), lit(2.0), lit(0.6)).alias("power")))


@query(f"WITH {ANCHOR_SQL}, r AS (SELECT f - 0.72 * (1 - exp(-n / 27.8::DOUBLE)) AS e FROM a) SELECT round(count(*) * ln(greatest(sum(e * e), 2.2250738585072014e-308) / count(*)) + 4, 6) AS aic FROM r")
def curve_aic(spark, d):
    e = F.col("f") - curve.saturating(F.col("n").cast("double"), F.lit(0.72), F.lit(27.8))
    return rounded(_anchors(spark).withColumn("e", e).agg(curve.aic(F.col("e"), 2).alias("aic")))


@query()
def curve_gap_bootstrap(spark, d):
    return curve.project_gap(spark, curve.fit_curve(*zip(*curve.ANCHORS, strict=True)), 70, 47)


@query()
def curve_sensitivity(spark, d):
    return curve.sensitivity(spark, curve.ANCHORS, [("adequate", "exponential", 70, 47), ("adequate", "power", 70, 47), ("all", "exponential", 69, 24)])


@query()
def curve_grid(spark, d):
    return curve.curve_grid(spark, curve.fit_curve(*zip(*curve.ANCHORS, strict=True)), 1.0, 1000.0)


# ---- labels

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({})), '[_/]+', ' ', 'g'), '[^a-z0-9 -]', '', 'g'), ' +', ' ', 'g'))"


def messy(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("source_dataset"), F.concat(F.replace(F.upper("p_type"), F.lit(" "), F.lit("_/")), F.lit("  (X)")).alias("source_label"))


def label_map(spark, d):
    """A map of the brands that do not end in 5: every seventh key excluded, the class named by the label."""
    rows = messy(spark, d).filter(~F.trim("source_dataset").endswith("5"))
    keys = rows.groupBy(records.tidy(F.col("source_dataset")).alias("source_dataset"), labels.normalise_label(F.col("source_label")).alias("source_label")).agg((F.length(F.first("source_label")) % 2 == 0).alias("excluded"))
    gone = F.col("excluded")
    return keys.select("source_dataset", "source_label", F.when(~gone, F.col("source_label")).alias("target_class"), F.when(~gone, F.substring("source_dataset", -1, 1)).alias("broad_category"), F.lit("exact").alias("route"), F.lit("ED80").alias("icd11"), F.lit(None).cast("string").alias("snomed"), "excluded", F.when(gone, "too_rare").alias("exclusion_reason"))


LM = f"""m AS (SELECT p_partkey, '  ' || p_brand || ' ' AS source_dataset, replace(upper(p_type), ' ', '_/') || '  (X)' AS source_label FROM part),
 lm AS (SELECT lower(trim(source_dataset)) AS dk, {_NORM.format('source_label')} AS lk, any_value(length(source_label)) % 2 = 0 AS ex FROM m WHERE NOT suffix(trim(source_dataset), '5') GROUP BY 1, 2)"""


@query(f"SELECT p_partkey, {_NORM.format('source_label')} AS label FROM (SELECT p_partkey, replace(upper(p_type), ' ', '_/') || '  (X)' AS source_label FROM part)")
def normalise_label(spark, d):
    return messy(spark, d).select("p_partkey", labels.normalise_label(F.col("source_label")).alias("label"))


@query(f"WITH {LM} SELECT DISTINCT source_dataset, source_label, {_NORM.format('source_label')} AS normalised FROM m")
def label_inventory(spark, d):
    rows = messy(spark, d)
    return labels.inventory_labels([rows.filter("p_partkey % 2 = 0"), rows.filter("p_partkey % 2 = 1")])


@query(f"""WITH {LM} SELECT p_partkey, CASE WHEN NOT ex THEN lk END AS target_class, CASE WHEN NOT ex THEN right(dk, 1) END AS broad_category, CASE WHEN ex IS NOT NULL THEN 'exact' END AS route, coalesce(ex, true) AS excluded,
 CASE WHEN ex IS NULL THEN 'unmappable' WHEN ex THEN 'too_rare' END AS exclusion_reason FROM m LEFT JOIN lm ON dk = lower(trim(source_dataset)) AND lk = {_NORM.format('source_label')}""")
def label_map_apply(spark, d):
    out = labels.apply_label_map(messy(spark, d), label_map(spark, d))
    return out.select("p_partkey", "target_class", "broad_category", "route", "excluded", "exclusion_reason")


@query(f"""WITH {LM}, k AS (SELECT right(dk, 1) AS c, count(DISTINCT lk) AS classes, count(*) AS mapped FROM lm WHERE NOT ex GROUP BY 1)
 SELECT c AS broad_category, classes, mapped, 0::BIGINT AS excluded FROM k UNION ALL SELECT 'Total', count(DISTINCT lk) FILTER (WHERE NOT ex), count(*) FILTER (WHERE NOT ex), count(*) FILTER (WHERE ex) FROM lm""")
def label_map_summary(spark, d):
    return labels.label_map_summary(label_map(spark, d))


# ---- duplicates and groups

GK = """g AS (SELECT *, CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag || '::patient::' || l_orderkey ELSE l_returnflag || '::cluster::' || l_partkey END AS group_key, CASE WHEN l_orderkey % 3 <> 0 THEN 'patient' ELSE 'cluster' END AS group_key_provenance FROM lineitem)"""


def grouped(spark, d):
    rows = table(spark, d, "lineitem").withColumn("patient_id", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey")))
    return dedup.group_keys(rows, dataset="l_returnflag", cluster="l_partkey")


@query(f"WITH {GK} SELECT l_orderkey, l_linenumber, group_key, group_key_provenance FROM g")
def group_keys(spark, d):
    return grouped(spark, d).select("l_orderkey", "l_linenumber", "group_key", "group_key_provenance")


@query(f"WITH {GK} SELECT count(DISTINCT l_returnflag) AS sources, count(DISTINCT group_key) AS groups, round(avg((group_key_provenance = 'patient')::INT) * 100, 6) AS patient_percent FROM g")
def group_statistics(spark, d):
    return rounded(grouped(spark, d).agg(F.count_distinct("l_returnflag").alias("sources"), F.count_distinct("group_key").alias("groups"), (F.avg((F.col("group_key_provenance") == "patient").cast("double")) * 100).alias("patient_percent")))


@query("SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_key, doc_id > min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents")
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(table(spark, d, "documents"), F.col("text"), "doc_id")


def _hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", F.conv(F.substring(F.md5(F.col("p_name").cast("binary")), 1, 8), 16, 10).cast("long").bitwiseXOR(F.expr("shiftleft(1L, cast(p_partkey % 31 as int))")).alias("h"))


HS = "h AS (SELECT p_partkey, xor(('0x' || substr(md5(p_name), 1, 8))::BIGINT, 1::BIGINT << CAST(p_partkey % 31 AS INT)) AS h FROM part), v AS (SELECT h, min(p_partkey) AS rep, count(*) AS n FROM h GROUP BY h)"
PAIRS = "p AS (SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, bit_count(xor(x.h, y.h))::INT AS distance, CASE WHEN x.rep < y.rep THEN x.n ELSE y.n END AS n_a, CASE WHEN x.rep < y.rep THEN y.n ELSE x.n END AS n_b FROM v x JOIN v y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 2)"
WALK = "e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w AS (SELECT rep AS k, rep AS r FROM v UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.k), c AS (SELECT k AS rep, min(r) AS m FROM w GROUP BY k)"


def _hash_links(spark, d):
    items = _hashes(spark, d)
    return items, dedup.hamming_links(dedup.hash_classes(items, key="p_partkey", value="h"), most=2, bits=32)


@query(f"WITH {HS}, {PAIRS} SELECT a, b, distance, n_a, n_b FROM p")
def near_duplicate_pairs(spark, d):
    return _hash_links(spark, d)[1]


@query(f"WITH {HS}, {PAIRS}, l AS (SELECT a AS rep, n_b AS m FROM p UNION ALL SELECT b, n_a FROM p), s AS (SELECT rep, sum(m) AS m FROM l GROUP BY rep) SELECT p_partkey, rep AS class, CAST(n - 1 + coalesce(m, 0) AS BIGINT) AS n_links FROM h JOIN v USING (h) LEFT JOIN s USING (rep)")
def near_duplicate_counts(spark, d):
    return dedup.hash_links(_hashes(spark, d), key="p_partkey", value="h", most=2, bits=32)


@query(f"WITH RECURSIVE {HS}, {PAIRS}, {WALK} SELECT p_partkey, m AS cluster FROM h JOIN v USING (h) JOIN c USING (rep)")
def duplicate_clusters(spark, d):
    items, links = _hash_links(spark, d)
    return dedup.clusters(items, links, "p_partkey", value="h")


@query(f"WITH RECURSIVE {HS}, {PAIRS}, {WALK} SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY m) - 1 AS INT) AS label FROM h JOIN v USING (h) JOIN c USING (rep)")
def cluster_labels(spark, d):
    return dedup.dense_labels(duplicate_clusters(spark, d), "p_partkey")


_SIGNS = " + ".join(f"(e[{i + 1}] > 0)::BIGINT * {1 << i}" for i in range(16))


@query(f"""WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_SIGNS.replace("e[", "embedding[")} AS h FROM embeddings), v AS (SELECT h, e, min(vec_id) AS class, count(*) AS n FROM r GROUP BY h, e),
 p AS (SELECT x.class AS a, y.class AS b, x.n AS n_a, y.n AS n_b FROM v x JOIN v y ON x.class < y.class AND bit_count(xor(x.h, y.h)) <= 1 AND list_cosine_similarity(x.e, y.e) >= 0.35),
 l AS (SELECT a AS class, n_b AS m FROM p UNION ALL SELECT b, n_a FROM p), s AS (SELECT class, sum(m) AS m FROM l GROUP BY class)
 SELECT vec_id, class, CAST(n - 1 + coalesce(m, 0) AS BIGINT) AS n_links FROM r JOIN v USING (h, e) LEFT JOIN s USING (class)""")
def hash_and_vector_links(spark, d):
    """Hash of 16 signs, at most one of which may differ, and a cosine of 0.35 or more."""
    rows = table(spark, d, "embeddings").withColumn("h", F.expr(" + ".join(f"CASE WHEN embedding[{i}] > 0 THEN {1 << i}L ELSE 0L END" for i in range(16))))
    return dedup.hash_and_vector_links(rows, key="vec_id", value="h", vector="embedding", most=1, least=0.35, bits=16)


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.35")
def cosine_pairs(spark, d):
    """A search: the vectors whose id is divisible by 100, against all."""
    rows = table(spark, d, "embeddings")
    return rounded(dedup.cosine_search(rows, rows.filter("vec_id % 100 = 0"), key="vec_id", vector="embedding", least=0.35))


# ---- skin tone and colour

IT = "i AS (SELECT l_orderkey, l_linenumber, 30 + l_quantity AS L, (l_linenumber - 4) * 5.0::DOUBLE AS b, CASE WHEN abs((l_linenumber - 4) * 5.0::DOUBLE) >= 1e-8 THEN degrees(atan((l_quantity - 20) / ((l_linenumber - 4) * 5.0::DOUBLE))) END AS ita FROM lineitem)"
CLS = "CASE WHEN ita IS NULL THEN {} WHEN ita > 55 THEN '{}' WHEN ita > 41 THEN '{}' WHEN ita > 28 THEN '{}' WHEN ita > 10 THEN '{}' WHEN ita > -30 THEN '{}' ELSE '{}' END"
_NAMES = [["NULL", *(row[2] for row in tone.BINS)], ["NULL", *(row[3] for row in tone.BINS)], ["'uncertain'", *(row[4] for row in tone.BINS)]]


def pixels(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 30).alias("L"), ((F.col("l_linenumber") - 4) * 5.0).alias("b"))
    return rows.withColumn("ita", tone.ita(F.col("L"), F.col("b")))


@query(f"WITH {IT} SELECT l_orderkey, l_linenumber, round(ita, 6) + 0.0::DOUBLE AS ita FROM i")
def ita_angle(spark, d):
    return rounded(pixels(spark, d).select("l_orderkey", "l_linenumber", "ita"))


@query(f"WITH {IT} SELECT l_orderkey, l_linenumber, {CLS.format(*_NAMES[0])} AS chardon, {CLS.format(*_NAMES[1])} AS fitzpatrick_group, {CLS.format(*_NAMES[2])} AS band FROM i")
def ita_class(spark, d):
    return pixels(spark, d).select("l_orderkey", "l_linenumber", tone.classify(F.col("ita")).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


IMG = f"""{IT}, q AS (SELECT l_orderkey, avg(L) AS ml, avg(b) AS mb, quantile_cont(ita, 0.75) - quantile_cont(ita, 0.25) AS iqr, count(*) AS n FROM i GROUP BY 1), z AS (SELECT *, CASE WHEN abs(mb) >= 1e-8 THEN degrees(atan((ml - 50) / mb)) END AS ita FROM q),
 y AS (SELECT *, CASE WHEN ita IS NULL THEN 0 ELSE abs(ita - 28) END AS mg FROM z), c AS (SELECT *, (least(n / 4.0::DOUBLE, 1) + CASE WHEN iqr IS NULL THEN 0 ELSE least(greatest(1 - iqr / 40, 0), 1) END + least(mg / 3, 1)) / 3 AS confidence, CASE WHEN n >= 4 AND iqr <= 40 AND mg >= 3 THEN 'high' ELSE 'low' END AS confidence_level, {CLS.format(*_NAMES[2])} AS band FROM y)"""


@query(f"WITH {IMG} SELECT l_orderkey, round(ita, 6) + 0.0::DOUBLE AS ita, round(iqr, 6) AS iqr, n AS n_skin_pixels, {CLS.format(*_NAMES[0])} AS chardon, {CLS.format(*_NAMES[1])} AS fitzpatrick_group, band, round(confidence, 6) AS confidence, confidence_level, 'ita_cielab_meanLb' AS method FROM c")
def image_ita(spark, d):
    return rounded(tone.estimate(pixels(spark, d).drop("ita"), "l_orderkey", min_pixels=4, max_iqr=40.0))


@query(f"""WITH {IMG}, s AS (SELECT *, CASE l_orderkey % 4 WHEN 0 THEN 'lighter' WHEN 1 THEN 'darker' WHEN 2 THEN 'uncertain' END AS src FROM c)
 SELECT l_orderkey, CASE WHEN src IN ('lighter', 'darker') THEN src WHEN band <> 'uncertain' AND confidence_level = 'high' THEN band ELSE 'uncertain' END AS band, CASE WHEN src IN ('lighter', 'darker') THEN 'source' WHEN band <> 'uncertain' AND confidence_level = 'high' THEN 'ita_high_confidence' ELSE 'none' END AS provenance,
 band AS ita_band, coalesce(src IN ('lighter', 'darker') AND band <> 'uncertain' AND src <> band, false) AS disagrees FROM s""")
def resolve_band(spark, d):
    img = tone.estimate(pixels(spark, d).drop("ita"), "l_orderkey", min_pixels=4, max_iqr=40.0)
    k = F.col("l_orderkey") % 4
    src = F.when(k == 0, "lighter").when(k == 1, "darker").when(k == 2, "uncertain")
    return img.select("l_orderkey", tone.resolve(src, F.col("band"), F.col("confidence_level")).alias("r")).select("l_orderkey", "r.*")


@query("SELECT r_regionkey, v.value, v.want AS band FROM region CROSS JOIN (VALUES ('1', 'lighter'), (' 3 ', 'lighter'), ('4', 'darker'), ('6', 'darker'), ('III', 'lighter'), ('v', 'darker'), ('3.0', 'uncertain'), ('7', 'uncertain'), ('', 'uncertain'), (NULL, 'uncertain')) v(value, want)")
def fitzpatrick_to_band(spark, d):
    values = spark.createDataFrame([(x,) for x in ("1", " 3 ", "4", "6", "III", "v", "3.0", "7", "", None)], "value string")
    rows = table(spark, d, "region").select("r_regionkey").join(values, F.lit(True))
    return rows.withColumn("band", records.band_or_uncertain(F.col("value"), text=True))


PX = "p AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 10 AS b FROM lineitem), s AS (SELECT *, CASE WHEN max(greatest(r, g, b)) OVER (PARTITION BY l_orderkey) > 1 THEN 255.0::DOUBLE ELSE 1 END AS k FROM p), u AS (SELECT l_orderkey, l_linenumber, r / k AS r, g / k AS g, b / k AS b FROM s), m AS (SELECT l_orderkey, pow(avg(pow(r, 6)), 1 / 6.0::DOUBLE) AS r, pow(avg(pow(g, 6)), 1 / 6.0::DOUBLE) AS g, pow(avg(pow(b, 6)), 1 / 6.0::DOUBLE) AS b FROM u GROUP BY 1), l AS (SELECT l_orderkey, r / sqrt(r * r + g * g + b * b) AS er, g / sqrt(r * r + g * g + b * b) AS eg, b / sqrt(r * r + g * g + b * b) AS eb FROM m)"


def colours(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 10).alias("b"))
    return colour.as_unit(rows, "l_orderkey")


@query(f"WITH {PX} SELECT l_orderkey, round(er, 6) AS er, round(eg, 6) AS eg, round(eb, 6) AS eb FROM l")
def illuminant(spark, d):
    return rounded(colour.illuminant(colours(spark, d), "l_orderkey"))


@query(f"WITH {PX} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(least(greatest({c} * (1 / sqrt(3.0::DOUBLE)) / greatest(e{c}, 1e-8), 0), 1), 6) AS {c}" for c in "rgb") + " FROM u JOIN l USING (l_orderkey)")
def colour_corrected(spark, d):
    return rounded(colour.shades_of_gray(colours(spark, d), "l_orderkey"))


@query("SELECT p_partkey, CASE WHEN 512.0::DOUBLE / least(w, h) < 1 THEN CAST(round_even(w * (512.0::DOUBLE / least(w, h)), 0) AS INT) ELSE w END AS width, CASE WHEN 512.0::DOUBLE / least(w, h) < 1 THEN CAST(round_even(h * (512.0::DOUBLE / least(w, h)), 0) AS INT) ELSE h END AS height FROM (SELECT p_partkey, CAST(p_size * 40 AS INT) AS w, CAST(300 + p_partkey % 1000 AS INT) AS h FROM part)")
def resize_geometry(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).cast("int").alias("w"), (F.col("p_partkey") % 1000 + 300).cast("int").alias("h"))
    return p.select("p_partkey", colour.resized(F.col("w"), F.col("h")).alias("s")).select("p_partkey", "s.*")


@query("SELECT vec_id, CAST((embedding[2] > embedding[1])::INT * 8 + (embedding[3] > embedding[2])::INT * 4 + (embedding[5] > embedding[4])::INT * 2 + (embedding[6] > embedding[5])::INT AS BIGINT) AS hash FROM embeddings")
def perceptual_hash(spark, d):
    return table(spark, d, "embeddings").select("vec_id", dedup.dhash(F.col("embedding"), 2).alias("hash"))


# ---- splits and sampling

PO = "o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS disease_label, CASE o_orderstatus WHEN 'F' THEN 'darker' WHEN 'O' THEN 'lighter' ELSE 'uncertain' END AS band FROM orders)"


def pool(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("disease_label"), F.when(s == "F", "darker").when(s == "O", "lighter").otherwise("uncertain").alias("band"))


def _split(spark, d):
    k = uniform_int(10, "split", F.col("o_custkey"))
    return pool(spark, d).withColumn("split", F.when(k < 7, "train").when(k < 8, "validation").otherwise("test"))


SP = f"{PO}, s AS (SELECT *, CASE WHEN k < 7 THEN 'train' WHEN k < 8 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, {ri(10, chr(39) + 'split' + chr(39), 'o_custkey')} AS k FROM o))"


@query()
def grouped_split(spark, d):
    return splits.stratified_group_split(pool(spark, d), label="disease_label", group="o_custkey", shards=8).select("o_orderkey", "o_custkey", "split")


@query(f"WITH {SP} SELECT disease_label, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1 ORDER BY 1 LIMIT 50")
def leakage_check(spark, d):
    return splits.leaking_groups(_split(spark, d), group="disease_label")


_SUM = "count(*) AS images, {} AS groups, count(*) FILTER (WHERE band = 'lighter') AS lighter, count(*) FILTER (WHERE band = 'darker') AS darker, count(*) FILTER (WHERE band = 'uncertain') AS uncertain, count(DISTINCT disease_label) AS classes, round(count(*) FILTER (WHERE band = 'darker') * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE band <> 'uncertain'), 0), 1) AS darker_percent"


@query(f"WITH {SP} SELECT split, {_SUM.format('count(DISTINCT o_custkey)')} FROM s GROUP BY split UNION ALL SELECT 'total', {_SUM.format('(SELECT sum(g)::BIGINT FROM (SELECT count(DISTINCT o_custkey) AS g FROM s GROUP BY split))')} FROM s")
def split_summary(spark, d):
    return splits.split_summary(_split(spark, d), label="disease_label", group="o_custkey")


@query(f"WITH {SP} SELECT split, CAST(o_custkey % 5 AS BIGINT) AS source_dataset, disease_label AS target_class, band, count(*) AS n FROM s WHERE band <> 'uncertain' GROUP BY ALL")
def split_source_class_counts(spark, d):
    rows = _split(spark, d).select("split", (F.col("o_custkey") % 5).alias("source_dataset"), F.col("disease_label").alias("target_class"), F.when(F.col("band") != "uncertain", F.col("band")).alias("band"))
    return splits.supplement_counts(rows)


CAPS = f"{PO}, c AS (SELECT disease_label, count(*) FILTER (WHERE band = 'darker') AS dk, count(*) FILTER (WHERE band = 'lighter') AS lt FROM o GROUP BY 1), f AS (SELECT *, least(dk / 0.5::DOUBLE, lt / 0.5::DOUBLE) AS cap FROM c)"


@query(f"WITH {CAPS} SELECT CAST(floor(min(cap)) AS BIGINT) AS max_n, (SELECT disease_label FROM f ORDER BY cap, disease_label LIMIT 1) AS binding_class, count(*) AS n_classes, CAST(floor(min(cap)) AS BIGINT) * count(*) AS total FROM f")
def feasible_n(spark, d):
    return sampling.max_feasible_n(pool(spark, d))


NAT = f"n AS (SELECT *, row_number() OVER (PARTITION BY disease_label ORDER BY md5(concat_ws(':', '2026', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS i FROM o)"
BAL = f"b AS (SELECT *, row_number() OVER (PARTITION BY disease_label, band ORDER BY md5(concat_ws(':', '2026', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS i FROM o WHERE band <> 'uncertain')"


@query(f"WITH {PO}, {NAT} SELECT o_orderkey, disease_label, band FROM n WHERE i <= 25")
def sample_natural(spark, d):
    return sampling.sample_training_set(pool(spark, d), 25, "natural", row_id="o_orderkey").select("o_orderkey", "disease_label", "band")


@query(f"WITH {PO}, {BAL} SELECT o_orderkey, disease_label, band FROM b WHERE i <= CASE WHEN band = 'darker' THEN 12 ELSE 13 END")
def sample_balanced(spark, d):
    return sampling.sample_training_set(pool(spark, d), 25, "balanced", row_id="o_orderkey").select("o_orderkey", "disease_label", "band")


@query(f"WITH {PO}, {NAT}, {BAL}, u AS (SELECT 'A1' AS setting, band FROM n WHERE i <= 25 UNION ALL SELECT 'A3', band FROM b WHERE i <= CASE WHEN band = 'darker' THEN 12 ELSE 13 END UNION ALL SELECT 'A5', band FROM o) SELECT setting, count(*) AS n_rows, round(avg((band = 'darker')::INT) FILTER (WHERE band <> 'uncertain') * 100, 1) AS darker_percent FROM u GROUP BY 1")
def ablation_ladder(spark, d):
    rungs = [sampling.composition(sampling.build_ablation(s, pool(spark, d), 25, row_id="o_orderkey")).select(F.lit(s).alias("setting"), "*") for s in ("A1", "A3", "A5")]
    return rungs[0].unionByName(rungs[1]).unionByName(rungs[2])


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), f AS (SELECT x AS label, greatest(coalesce(n, 0), 1) AS n FROM range(12) t(x) LEFT JOIN c ON c.label = x) SELECT CAST(label AS BIGINT) AS label, CAST(n AS BIGINT) AS n, round(sum(n) OVER ()::DOUBLE / (12 * n), 6) AS weight FROM f")
def class_weights(spark, d):
    return rounded(sampling.class_weights(table(spark, d, "embeddings"), 12))


EB = "CASE WHEN vec_id % 7 = 6 THEN 'uncertain' WHEN vec_id % 5 < 3 THEN 'lighter' ELSE 'darker' END"


@query(f"WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), f AS (SELECT x AS label, greatest(coalesce(n, 0), 1) AS n FROM range(12) t(x) LEFT JOIN c ON c.label = x), w AS (SELECT label, sum(n) OVER ()::DOUBLE / (12 * n) AS w FROM f), e AS (SELECT vec_id, label, {EB} AS band FROM embeddings) SELECT vec_id, e.band, round(w * CASE WHEN e.band = 'uncertain' THEN 1 ELSE count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY e.band)) END, 6) AS weight FROM e JOIN w USING (label)")
def tone_weights(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.expr(EB).alias("band"))
    return rounded(sampling.tone_weights(rows, 12).select("vec_id", "band", "weight"))


# ---- metrics


@query("WITH e AS (SELECT event_type = 'purchase' AS pos, value AS s, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM events) SELECT round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auroc FROM e")
def binary_auroc(spark, d):
    rows = table(spark, d, "events").select(F.lit(1).alias("run"), F.col("value").alias("s"), (F.col("event_type") == "purchase").alias("pos"))
    return rounded(metrics.binary_auroc(rows, by=["run"], score="s", positive="pos").select("auroc"))


K = 10


def predictions(spark, d, seeds: int = 1, settings: tuple[str, ...] = ("A1",)) -> DataFrame:
    """Labels of the embeddings with integer scores from md5, ties included; the true class gets a head start."""
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("y_true"), F.expr(EB).alias("band"), (F.col("vec_id") % 40).alias("group"), F.element_at(F.array(*[F.lit(x) for x in metrics.EXTERNAL]), (F.col("vec_id") % 3 + 1).cast("int")).alias("fst_group"))
    runs = spark.createDataFrame([(s, i) for s in settings for i in range(seeds)], "setting string, seed int")
    rows = base.join(runs, F.lit(True))
    score = [uniform_int(50, F.col("setting"), F.col("seed"), F.col("row_id"), c).cast("double") + F.when(F.col("y_true") == c, 12.0).otherwise(0.0) for c in range(K)]
    return rows.withColumn("probs", F.array(*score)).filter(~((F.col("y_true") >= 8) & (F.col("band") == "darker")))


def pred_sql(seeds: int = 1, settings: tuple[str, ...] = ("A1",)) -> str:
    values = ", ".join(f"('{s}', {i})" for s in settings for i in range(seeds))
    return f"""b AS (SELECT vec_id AS row_id, label AS y_true, {EB} AS band, vec_id % 40 AS grp, ['I-II', 'III-IV', 'V-VI'][vec_id % 3 + 1] AS fst FROM embeddings), runs(setting, seed) AS (VALUES {values}),
 x AS (SELECT b.*, setting, seed FROM b, runs WHERE NOT (y_true >= 8 AND band = 'darker')), s AS (SELECT x.*, c, {ri(50, 'setting', 'seed', 'row_id', 'c')}::DOUBLE + CASE WHEN y_true = c THEN 12 ELSE 0 END AS score FROM x, range({K}) t(c)),
 pr AS (SELECT setting, seed, row_id, any_value(y_true) AS y_true, any_value(band) AS band, any_value(grp) AS grp, arg_max(c, score * 100 - c) AS pred FROM s GROUP BY 1, 2, 3), cc AS (SELECT y_true FROM b WHERE band IN ('lighter', 'darker') AND NOT (y_true >= 8 AND band = 'darker') GROUP BY 1 HAVING count(DISTINCT band) = 2)"""


def auroc_sql(name: str, source: str, keys: str) -> str:
    return f"""{name}_r AS (SELECT {keys}, c, y_true = c AS pos, rank() OVER (PARTITION BY {keys}, c ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, c, score) - 1) / 2.0::DOUBLE AS r FROM {source}),
 {name}_c AS (SELECT {keys}, c, (sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos), 0) AS a FROM {name}_r GROUP BY {keys}, c), {name} AS (SELECT {keys}, avg(a) AS auroc FROM {name}_c GROUP BY {keys})"""


PF = f"{pred_sql()}, {auroc_sql('st', '(SELECT * FROM s WHERE band IN (' + chr(39) + 'lighter' + chr(39) + ', ' + chr(39) + 'darker' + chr(39) + ') AND c IN (SELECT y_true FROM cc))', 'setting, seed, band')}, " + """
 sf_c AS (SELECT setting, seed, band, k, 2.0::DOUBLE * count(*) FILTER (WHERE y_true = k AND pred = k) / nullif(count(*) FILTER (WHERE y_true = k) + count(*) FILTER (WHERE pred = k), 0) AS f FROM (SELECT * FROM pr WHERE band IN ('lighter', 'darker') AND y_true IN (SELECT y_true FROM cc)), (SELECT y_true AS k FROM cc) GROUP BY 1, 2, 3, 4),
 sf AS (SELECT setting, seed, band, avg(coalesce(f, 0)) AS macro_f1 FROM sf_c GROUP BY 1, 2, 3)"""


@query(f"WITH {pred_sql()}, {auroc_sql('wh', 's', 'setting, seed')} SELECT setting, seed, round(auroc, 6) AS auroc FROM wh")
def macro_auroc(spark, d):
    return rounded(metrics.macro_auroc(predictions(spark, d), by=["setting", "seed"]))


@query(f"""WITH {pred_sql()}, f AS (SELECT k, 2.0::DOUBLE * count(*) FILTER (WHERE y_true = k AND pred = k) / (count(*) FILTER (WHERE y_true = k) + count(*) FILTER (WHERE pred = k)) AS f, count(*) FILTER (WHERE y_true = k AND pred = k)::DOUBLE / nullif(count(*) FILTER (WHERE y_true = k), 0) AS rec FROM pr, (SELECT y_true AS k FROM pr UNION SELECT pred FROM pr) GROUP BY k)
 SELECT 'A1' AS setting, 0 AS seed, round(avg(f), 6) AS macro_f1, (SELECT round(avg((y_true = pred)::INT), 6) FROM pr) AS accuracy, round(avg(rec), 6) AS balanced_accuracy FROM f""")
def classification_metrics(spark, d):
    return rounded(metrics.classification(predictions(spark, d), by=["setting", "seed"]))


@query(f"WITH {PF} SELECT setting, seed, band, round(auroc, 6) AS auroc, round(macro_f1, 6) AS macro_f1 FROM st JOIN sf USING (setting, seed, band)")
def stratum_metrics(spark, d):
    p = cut(predictions(spark, d))  # used three times
    return rounded(metrics.stratum_metrics(p, by=["setting", "seed"], classes=metrics.common_classes(p)))


@query(f"""WITH {PF}, w AS (SELECT setting, seed, max(auroc) FILTER (WHERE band = 'lighter') AS l, max(auroc) FILTER (WHERE band = 'darker') AS k, min(auroc) AS wa, min(macro_f1) AS wf FROM st JOIN sf USING (setting, seed, band) GROUP BY 1, 2)
 SELECT setting, seed, round(l - k, 6) AS delta, CASE WHEN k < l THEN 'darker' ELSE 'lighter' END AS worst_group, round(wa, 6) AS worst_auroc, round(wf, 6) AS worst_f1, round(abs(l - k), 6) AS abs_delta FROM w""")
def fairness_metrics(spark, d):
    p = cut(predictions(spark, d))
    by = ["setting", "seed"]
    return rounded(metrics.fairness(metrics.stratum_metrics(p, by=by, classes=metrics.common_classes(p)), by=by))


@query("WITH b AS (SELECT label AS y_true, CASE WHEN vec_id % 7 = 6 THEN 'uncertain' WHEN vec_id % 5 < 3 THEN 'lighter' ELSE 'darker' END AS band FROM embeddings) SELECT CAST(y_true AS INT) AS y_true FROM b WHERE band <> 'uncertain' AND NOT (y_true >= 8 AND band = 'darker') GROUP BY 1 HAVING count(DISTINCT band) = 2")
def common_classes(spark, d):
    return metrics.common_classes(predictions(spark, d))


_TAGS = "(SELECT s.* EXCLUDE (fst), unnest(list_filter([fst, CASE WHEN fst <> 'V-VI' THEN 'LM' END, CASE WHEN fst <> 'I-II' THEN 'MH' END], lambda q: q IS NOT NULL)) AS tag FROM s WHERE c IN (SELECT y_true FROM x WHERE fst <> 'III-IV' GROUP BY 1 HAVING count(DISTINCT fst) = 2))"


@query(f"""WITH {pred_sql()}, {auroc_sql('ex', _TAGS, 'setting, seed, tag')}, w AS (SELECT setting, seed, max(auroc) FILTER (WHERE tag = 'I-II') AS a, max(auroc) FILTER (WHERE tag = 'III-IV') AS m, max(auroc) FILTER (WHERE tag = 'V-VI') AS h, max(auroc) FILTER (WHERE tag = 'LM') AS lm, max(auroc) FILTER (WHERE tag = 'MH') AS mh FROM ex GROUP BY 1, 2)
 SELECT setting, seed, round(a, 6) AS auroc_low, round(m, 6) AS auroc_middle, round(h, 6) AS auroc_high, round(a - h, 6) AS gap_primary, round(lm - h, 6) AS gap_middle_with_lighter, round(a - mh, 6) AS gap_middle_with_darker FROM w""")
def external_gaps(spark, d):
    return rounded(metrics.external_gaps(cut(predictions(spark, d)), by=["setting", "seed"]))


@query(f"WITH {pred_sql(3)}, {auroc_sql('wh', 's', 'setting, seed')} SELECT setting, round(avg(auroc), 6) AS auroc_mean, round(coalesce(stddev_samp(auroc), 0), 6) AS auroc_sd FROM wh GROUP BY 1")
def seed_summary(spark, d):
    return rounded(metrics.over_seeds(metrics.macro_auroc(predictions(spark, d, 3), by=["setting", "seed"]), ["auroc"]))


# ---- bootstrap

REPS = 2000

GW = f"""gs AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY grp) - 1 AS slot, count(*) OVER (PARTITION BY band) AS size FROM (SELECT DISTINCT band, grp FROM x)),
 dr AS (SELECT rep, band, {ri('size', '2026', 'rep', 'band', 'slot')} AS slot FROM gs, range({REPS}) t(rep)), gw AS (SELECT dr.rep, dr.band, gs.grp, count(*) AS w FROM dr JOIN gs USING (band, slot) GROUP BY 1, 2, 3)"""
DR = f"""wr AS (SELECT setting, seed, rep, band, c, score, sum(w) FILTER (WHERE y_true = c) AS p, sum(w) FILTER (WHERE y_true <> c) AS n FROM s JOIN gw USING (band, grp) WHERE band <> 'uncertain' AND c IN (SELECT y_true FROM cc) GROUP BY ALL),
 wb AS (SELECT *, coalesce(p, 0) * (coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY setting, seed, rep, band, c ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(n, 0) / 2.0::DOUBLE) AS u FROM wr),
 wa AS (SELECT setting, seed, rep, band, c, sum(u) / nullif(sum(p) * sum(n), 0) AS a FROM wb GROUP BY ALL), wd AS (SELECT setting, seed, rep, max(a) FILTER (WHERE band = 'lighter') - max(a) FILTER (WHERE band = 'darker') AS delta FROM (SELECT setting, seed, rep, band, avg(a) AS a FROM wa GROUP BY ALL) GROUP BY ALL),
 rp AS (SELECT setting, rep, avg(delta) AS delta FROM wd GROUP BY ALL)"""


@query(f"WITH {pred_sql()}, {GW} SELECT CAST(rep AS INT) AS rep, band, grp AS \"group\", w FROM gw")
def group_bootstrap_weights(spark, d):
    return bootstrap.group_weights(predictions(spark, d), REPS)


def _replicates(spark, d, settings, drop_missing):
    p = cut(predictions(spark, d, 1, settings))
    raw = bootstrap.delta_replicates(p, bootstrap.group_weights(p, REPS), by=["setting", "seed"], classes=metrics.common_classes(p))
    return bootstrap.mean_over_seeds(raw, drop_missing=drop_missing)


@query(f"WITH {pred_sql()}, {GW}, {DR} SELECT setting, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, count(delta) AS n_ok FROM rp WHERE delta IS NOT NULL GROUP BY 1")
def bootstrap_delta_ci(spark, d):
    return rounded(bootstrap.interval(_replicates(spark, d, ("A1",), True)))


@query(f"""WITH {pred_sql(1, ('A1', 'A2'))}, {GW}, {DR}, df AS (SELECT t.delta - c.delta AS d FROM rp t JOIN rp c ON t.rep = c.rep AND t.setting = 'A2' AND c.setting = 'A1')
 SELECT 'A2' AS treatment, 'A1' AS comparator, round(avg(d), 6) AS diff, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 6) AS p, count(*) AS n_ok FROM df WHERE d IS NOT NULL""")
def paired_bootstrap(spark, d):
    return rounded(bootstrap.paired_test(_replicates(spark, d, ("A1", "A2"), False), "A2", "A1"))


@query()
def bootstrap_blocks(spark, d):
    rows = bootstrap.collected(predictions(spark, d).select("y_true", "band", "group", F.get("probs", F.lit(0)).alias("score")).orderBy("group", "score"))
    return bootstrap.bootstrap_metric(spark, rows, lambda t, w: bootstrap.weighted_auroc((t["y_true"] == 0).to_numpy(), t["score"].to_numpy(), w))


@query("WITH p(ordinal, p) AS (VALUES (1, 0.006::DOUBLE), (2, 0.271), (3, 0.284), (4, 0.003), (5, 0.028), (6, NULL)), s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p NULLS LAST, ordinal) + 1) * p AS a FROM p) SELECT ordinal, p, round(least(1.0, max(a) OVER (ORDER BY p NULLS LAST, ordinal ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM s")
def holm(spark, d):
    rows = spark.createDataFrame([(1, 0.006), (2, 0.271), (3, 0.284), (4, 0.003), (5, 0.028), (6, None)], "ordinal int, p double")
    return rounded(bootstrap.holm(rows))


@query("SELECT * FROM (VALUES ('A2', 'A1'), ('A3', 'A1')) v(treatment, comparator)")
def available_comparisons(spark, d):
    return sampling.available_comparisons(spark, spark.createDataFrame([("A1",), ("A2",), ("A3",)], "setting string")).select("treatment", "comparator")


# ---- reports and captions


def reported(spark, d, dear=False):
    p = table(spark, d, "part")
    p = spread(p, "p_partkey") if dear else p
    blank = lambda c, k: F.when(F.col("p_partkey") % k != 0, F.col(c))
    cols = {"case_id": F.col("p_partkey"), "disease_label": F.col("p_type"), "analysis_band": F.when(F.col("p_size") > 25, "darker").otherwise("lighter"), "anatomical_site": blank("p_brand", 3), "lesion_morphology": blank("p_name", 4), "diagnosis_certainty": blank("p_brand", 5), "source_dataset": F.col("p_brand")}
    return reports.build_report(p, cols).select("p_partkey", "report")


_CAP = "'A clinical photograph showing ' || lower(p_type) || CASE WHEN p_partkey % 3 <> 0 THEN ' on the ' || lower(p_brand) ELSE '' END || '.' || CASE WHEN p_partkey % 4 <> 0 THEN ' The recorded morphology is ' || lower(p_name) || '.' ELSE '' END || CASE WHEN p_partkey % 5 <> 0 THEN ' Diagnosis certainty: ' || lower(p_brand) || '.' ELSE '' END"


@query(f"SELECT p_partkey, {_CAP} AS caption FROM part")
def caption_template(spark, d):
    return reported(spark, d).select("p_partkey", captions.template_caption(F.col("report")).alias("caption"))


@query(f"SELECT p_partkey, p_type AS class_name, {_CAP} AS template, CASE WHEN p_partkey % 2 = 0 THEN 'written ' || p_partkey ELSE {_CAP} END AS language_model FROM part")
def caption_variants(spark, d):
    rows = reported(spark, d)
    more = F.create_map(F.lit("caption_template"), reports.field(captions.template_caption(F.col("report")), "C"), F.lit("caption_lm"), reports.field(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("written "), F.col("p_partkey").cast("string"))), "L"))
    rows = rows.withColumn("report", F.map_concat(F.map_filter("report", lambda k, v: ~k.startswith("caption")), more))
    return rows.select("p_partkey", *[captions.caption_for_variant(F.col("report"), v).alias(v) for v in captions.VARIANTS])


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'unknown field: mood' WHEN 2 THEN 'disease_label: language model may not write a structured field; disease_label: provenance ''L'' not permitted (allowed: [''C'', ''E''])' ELSE 'missing required field: case_id' END AS problems FROM part")
def report_validation(spark, d):
    rows = reported(spark, d)
    k, r = F.col("p_partkey") % 4, F.col("report")
    odd = F.when(k == 1, F.map_concat(r, F.create_map(F.lit("mood"), F.struct(F.lit("x").alias("value"), F.lit("S").alias("provenance")))))
    odd = odd.when(k == 2, F.map_concat(F.map_filter(r, lambda n, v: n != "disease_label"), F.create_map(F.lit("disease_label"), F.struct(F.lit("x").alias("value"), F.lit("L").alias("provenance")))))
    odd = odd.when(k == 3, F.map_filter(r, lambda n, v: n != "case_id")).otherwise(r)
    return rows.select("p_partkey", F.array_join(F.array_sort(reports.problems(odd)), "; ").alias("problems"))


_COV = {"case_id": ("1=1", "C"), "source_dataset": ("1=1", "S"), "disease_label": ("1=1", "C"), "analysis_band": ("1=1", "C"), "anatomical_site": ("p_partkey % 3 <> 0", "S"), "lesion_morphology": ("p_partkey % 4 <> 0", "S"), "diagnosis_certainty": ("p_partkey % 5 <> 0", "S"), "source_label": ("1=0", "S"), "fitzpatrick_source": ("1=0", "S"), "ita_value": ("1=0", "C"), "ita_confidence": ("1=0", "C"), "age_band": ("1=0", "S"), "sex": ("1=0", "S"), "image_quality_flags": ("1=0", ""), "caption_template": ("1=0", "C"), "caption_lm": ("1=0", "L"), "validation_status": ("1=0", "E")}


@query(" UNION ALL ".join(f"SELECT '{k}' AS field, count(*) FILTER (WHERE {c}) AS present, round(count(*) FILTER (WHERE {c}) * 100.0::DOUBLE / count(*), 1) AS percent, '{t}' AS tags FROM part" for k, (c, t) in _COV.items()))
def field_coverage(spark, d):
    return reports.coverage(reported(spark, d))


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _named(kind: str, word: str) -> str:
    return f"'{kind}: ' || chr(39) || {word} || chr(39)"


_NEG = "len(list_filter(list_slice(string_split_regex(trim({}), '\\s+'), -" + str(captions.NEGATION_WINDOW) + ", -1), lambda q: list_contains(" + _listed(captions.NEGATION_CUES) + ", trim(q, '.,;:')))) > 0"
_FORMS = "CASE WHEN {0} IS NULL THEN [] ELSE [{0}] || list_filter(string_split_regex({0}, '[\\s/,-]+'), lambda q: len(q) > 3) END"
_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN {_named('forbidden_' + k, 'm')}" for k, p in captions.FORBIDDEN.items()) + " END"
_UNION = "|".join(f"(?:{p})".replace("(", "(?:").replace("(?:?:", "(?:") for p in captions.FORBIDDEN.values())
_BEFORE = _NEG.format("left(t, position(w IN t) - 1)")
CHECK = f"""c0 AS (SELECT p_partkey, lower({_CAP} || CASE WHEN p_partkey % 2 = 0 THEN ' Treatment: apply 5 mg on the face.' ELSE '' END) AS t,
  {_FORMS.format("(CASE WHEN p_partkey % 3 <> 0 THEN lower(p_brand) END)")} AS site, {_FORMS.format("(CASE WHEN p_partkey % 4 <> 0 THEN lower(p_name) END)")} AS shape, {_FORMS.format("lower(p_type)")} AS label FROM part),
 c1 AS (SELECT *, regexp_extract_all(t, '\\w+') AS tokens, string_split(regexp_replace(t, '({_UNION})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM c0),
 c2 AS (SELECT *, list_transform(list_filter(range(2, len(parts) + 1), lambda i: NOT {_NEG.format("replace(array_to_string(parts[:i - 1], ''), chr(2), '')")}), lambda i: string_split(parts[i], chr(2))[1]) AS matches FROM c1),
 c3 AS (SELECT p_partkey, list_sort(list_distinct(list_transform(matches, lambda m: {_KINDS})
  || CASE WHEN len(site) > 0 THEN list_transform(list_filter({_listed(captions.SITES)}, lambda w: list_contains(tokens, w) AND NOT list_contains(site, w) AND NOT {_BEFORE}), lambda w: {_named('unsupported_site', 'w')}) ELSE [] END
  || list_transform(list_filter({_listed(captions.MORPHOLOGY)}, lambda w: len(list_filter(tokens, lambda x: starts_with(x, w))) > 0 AND NOT list_contains(shape, w) AND NOT {_BEFORE}), lambda w: {_named('unsupported_descriptor', 'w')})
  || CASE WHEN len(label) > 0 AND len(list_filter(label, lambda x: contains(t, x))) = 0 THEN ['diagnosis_not_stated_or_changed'] ELSE [] END
  || list_transform(list_filter({_listed(captions.TONES)}, lambda w: contains(t, w)), lambda w: {_named('unsupported_skin_tone', 'w')}))) AS v FROM c2)"""


@query(f"WITH {CHECK} SELECT p_partkey, len(v) = 0 AS ok, array_to_string(v, '; ') AS violations FROM c3")
def caption_check(spark, d):
    rows = reported(spark, d, dear=True)
    said = F.concat(captions.template_caption(F.col("report")), F.when(F.col("p_partkey") % 2 == 0, F.lit(" Treatment: apply 5 mg on the face.")).otherwise(F.lit("")))
    return captions.check_captions(rows.withColumn("caption", said)).select("p_partkey", "ok", F.array_join("violations", "; ").alias("violations"))


@query(f"WITH r AS (SELECT len(list_filter({_FORMS.format('lower(p_type)')}, lambda x: contains('a clinical photograph showing economy', x))) > 0 AS good FROM part) SELECT CASE WHEN good THEN 'lm_regenerated' ELSE 'template_fallback' END AS route, NOT good AS flagged, count(*) AS n FROM r GROUP BY ALL")
def caption_routes(spark, d):
    """A model whose first answer names a shape that no record has, and whose second names one type alone."""

    def model(ask: str) -> str:
        return "A clinical photograph showing " + ("economy" if "broke these rules" in ask else "an erythematous plaque")

    out = captions.generate_captions(reported(spark, d, dear=True), model, key="p_partkey")
    return out.groupBy("route", "flagged").agg(F.count("*").alias("n"))


@query()
def linear_probe(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.col("label").cast("int").alias("label"))
    out = probe.linear_probe(rows.filter("vec_id % 4 <> 0"), rows.filter("vec_id % 4 = 0"), max_iter=50)
    return out.select("vec_id", "label", metrics.predicted(F.col("probs")).alias("predicted"))


@query("WITH e AS (SELECT vec_id, vec_id // 32 AS batch, embedding::DOUBLE[] AS a, embedding[2:64]::DOUBLE[] || [0.5::DOUBLE] AS b FROM embeddings), s AS (SELECT batch, x.vec_id AS i, y.vec_id AS j, list_cosine_similarity(x.a, y.b) / 0.07 AS s FROM e x JOIN e y USING (batch)), l AS (SELECT batch, ln(sum(exp(s))) - max(s) FILTER (WHERE i = j) AS l FROM s GROUP BY batch, i UNION ALL SELECT batch, ln(sum(exp(s))) - max(s) FILTER (WHERE i = j) FROM s GROUP BY batch, j) SELECT CAST(batch AS BIGINT) AS batch, CAST(count(*) / 2 AS BIGINT) AS n, round(avg(l), 6) AS loss FROM l GROUP BY batch")
def contrastive_loss(spark, d):
    """All embeddings, in batches of 32 ids."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 32").alias("batch"), F.col("embedding").cast("array<double>").alias("image"))
    e = e.withColumn("text", F.concat(F.slice("image", 2, 63), F.array(F.lit(0.5))))
    return rounded(metrics.contrastive_loss(e))
