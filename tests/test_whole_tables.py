"""Queries run over whole tables and not over the ids that the smallest scales have."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import captions
from tessera.plans import catalog


@pytest.fixture(scope="module")
def part(spark, tmp_path_factory):
    """Part keys on both sides of 2000, with names that repeat every ten keys."""
    folder = tmp_path_factory.mktemp("tables")
    keys = spark.range(1940, 2060).select(F.col("id").alias("p_partkey"), F.concat(F.lit("name "), F.col("id") % 10).alias("p_name"))
    keys.select("*", F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_hash_pairs_and_clusters_over_all_of_part(spark, part):
    h = {r["p_partkey"]: r["h"] for r in catalog._hashes(spark, part).collect()}
    assert len(h) == 120
    first = {v: min(k for k in h if h[k] == v) for v in h.values()}
    size = {v: list(h.values()).count(v) for v in first}
    near = lambda a, b: (h[a] ^ h[b]).bit_count() <= 2
    pairs = {(a, b, (h[a] ^ h[b]).bit_count(), size[h[a]], size[h[b]]) for a in first.values() for b in first.values() if a < b and near(a, b)}
    assert {tuple(r) for r in catalog.queries()["near_duplicate_pairs"](spark, part).select("a", "b", "distance", "n_a", "n_b").collect()} == pairs
    assert {tuple(r) for r in catalog.queries()["near_duplicate_counts"](spark, part).select("p_partkey", "class", "n_links").collect()} == {(k, first[h[k]], sum(near(k, j) for j in h) - 1) for k in h}
    want = [(a, b) for a in h for b in h if a < b and near(a, b)]
    assert any(a > 2000 for a, _ in want)
    up = {k: k for k in h}
    for _ in h:
        for a, b in want:
            up[a] = up[b] = min(up[a], up[b])
    assert {r["p_partkey"]: r["cluster"] for r in catalog.queries()["duplicate_clusters"](spark, part).collect()} == up
    order = {c: i for i, c in enumerate(sorted(set(up.values())))}
    assert {r["p_partkey"]: r["label"] for r in catalog.queries()["cluster_labels"](spark, part).collect()} == {k: order[c] for k, c in up.items()}


def test_cosine_pairs_over_all_embeddings(spark, tmp_path):
    rows = [(k, [float((k * j) % 7 - 3) for j in range(1, 9)]) for k in range(490, 512)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    cosine = lambda x, y: dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if dot(x, x) * dot(y, y) else 0.0
    want = {(a, b): cosine(x, y) for a, x in rows for b, y in rows if a == 500 and a != b and cosine(x, y) >= 0.35}
    assert any(b >= 500 for _, b in want)
    got = {(r["a"], r["b"]): r["cosine"] for r in catalog.queries()["cosine_pairs"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_caption_routes_over_all_of_part(spark, part):
    assert sum(r["n"] for r in catalog.queries()["caption_routes"](spark, part).collect()) == 120


def test_captions_are_checked_on_all_cores(spark, part):
    """A small file of many rows is one partition."""
    assert catalog.queries()["caption_check"](spark, part).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_caption_is_cut_into_words_once(spark):
    asked = captions.violations(F.col("caption"), F.col("report"))._jc.toString()
    assert asked.count("regexp_extract_all") == 1


def test_only_what_the_model_reads_goes_to_python(spark, part, monkeypatch):
    """Reports stay in the JVM: whole rows are not handed over and back."""
    plans, fields, cut = [], [], captions.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        fields.append(df.agg(F.max(F.size("report"))).first()[0])
        return cut(df)

    monkeypatch.setattr(captions, "cut", seen)
    assert sum(r["n"] for r in catalog.queries()["caption_routes"](spark, part).collect()) == 120
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)
    assert max(fields) == 4  # of 16: what the checker and the template read is all that a round cuts
