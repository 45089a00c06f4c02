"""Published anchors, boundaries and invariants of the audit and evaluation operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import bootstrap, captions, colour, components, curve, dedup, labels, metrics, records, reports, sampling, splits, tone
from tessera.plans import workflows
from tessera.sources import predictions, sinks


def test_tails():
    assert stats.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5)
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)


@pytest.fixture(scope="module")
def fit():
    return curve.fit_curve(*zip(*curve.ANCHORS, strict=True))


def test_curve_anchors(spark, fit):
    assert fit.params[0] == pytest.approx(0.720, abs=5e-4) and fit.params[1] == pytest.approx(27.8, abs=0.1)
    row = curve.project_gap(spark, fit, 70, 47, n_boot=100).first()
    assert row["f_lighter"] == pytest.approx(0.662, abs=2e-3) and row["f_darker"] == pytest.approx(0.587, abs=2e-3)
    assert row["low"] <= row["gap"] <= row["high"] and row["n_ok"] == 100
    for (lighter, darker), gap in {(68, 44): 0.086, (70, 47): 0.075, (77, 54): 0.058, (91, 69): 0.033, (69, 24): 0.244}.items():
        assert float(fit(lighter)[0] - fit(darker)[0]) == pytest.approx(gap, abs=3e-3)
    power = curve.fit_curve(*zip(*curve.ANCHORS, strict=True), "power")
    assert float(power(70)[0] - power(47)[0]) == pytest.approx(0.049, abs=3e-3) and power.aic() > fit.aic()
    assert fit.r_squared() > 0.9999 and fit.imprecise_anchors()
    assert (np.diff(fit(np.arange(10, 500))) > 0).all()
    with pytest.raises(ValueError):
        curve.fit_curve([1, 2], [0.1, 0.2])


def test_tone_boundaries(spark):
    cases = {70.0: "very light", 55.0: "light", 45.0: "light", 41.0: "intermediate", 30.0: "intermediate", 28.001: "intermediate", 28.0: "tan", 15.0: "tan", 10.0: "brown", -20.0: "brown", -30.0: "dark", -50.0: "dark", math.nan: None, math.inf: None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "ita double").select("ita", tone.classify(F.col("ita")).alias("c"))
    for r in df.collect():
        known = r["ita"] is not None and math.isfinite(r["ita"])
        assert r["c"]["chardon"] == (cases[r["ita"]] if known else None)
        assert known or (r["c"]["fitzpatrick_group"], r["c"]["band"]) == (None, "uncertain")
    assert spark.range(1).select(tone.ita(F.lit(65.0), F.lit(12.0))).first()[0] == pytest.approx(51.34, abs=0.01)


def test_resolve_precedence(spark):
    rows = [("lighter", "darker", "low"), (None, "darker", "high"), (None, "darker", "low"), ("uncertain", "lighter", "high")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, i string, l string").coalesce(1).select(tone.resolve(F.col("s"), F.col("i"), F.col("l"))).collect()]
    assert [(g["band"], g["provenance"]) for g in got] == [("lighter", "source"), ("darker", "ita_high_confidence"), ("uncertain", "none"), ("lighter", "ita_high_confidence")]
    assert got[0]["disagrees"]


def test_clean_records(spark, tmp_path):
    lines = ["fitzpatrick_scale,label,three_partition_label,qc", "1, Psoriasis ,Benign,", "2.5,psoriasis,malignant,", "0,x,benign,", "7,x,benign,", "-1,x,benign,", "four,x,benign,", ",x,benign,", "5,eczema,Malignant, WRONG ", "6,eczema,malignant,3 Wrongly labelled", "4,eczema,benign,1"]
    path = tmp_path / "meta.csv"
    path.write_text("\n".join(lines))
    got = records.load_metadata(spark, str(path), category="three_partition_label", qc="qc").select("fitzpatrick", "condition", "category", "band").collect()
    assert sorted(map(tuple, got)) == [(1, "psoriasis", "benign", "lighter"), (2, "psoriasis", "malignant", "lighter"), (6, "eczema", "malignant", "darker")]
    with pytest.raises(KeyError):
        records.load_metadata(spark, str(path), scale="nope")
    out = workflows.audit(spark, str(path), category="three_partition_label", qc="qc", n_boot=10)
    assert out["representation"].count() == 6 and out["coverage"].first()["adequate_lighter"] == 0


def test_label_map(spark):
    table = spark.createDataFrame([("A ", "Foo_Bar", "foo", "x", "exact", None, None, 0, None), ("a", "junk", None, None, "expert", None, None, 1, "out_of_scope")], labels.MAP_SCHEMA).withColumn("excluded", F.col("excluded") == 1)
    labels.validate_label_map(table)
    rows = spark.createDataFrame([("a", " foo bar!"), ("A", "junk"), ("a", "other"), (None, None)], "source_dataset string, source_label string")
    got = {(r["source_dataset"], r["source_label"]): (r["target_class"], r["excluded"], r["exclusion_reason"]) for r in labels.apply_label_map(rows, table).collect()}
    assert got == {("a", " foo bar!"): ("foo", False, None), ("A", "junk"): (None, True, "out_of_scope"), ("a", "other"): (None, True, "unmappable"), (None, None): (None, True, "unmappable")}
    with pytest.raises(ValueError):
        labels.validate_label_map(table.unionByName(table))
    with pytest.raises(ValueError):
        labels.validate_label_map(table.withColumn("route", F.lit("guess")))
    with pytest.raises(ValueError):
        labels.reject_source(spark.createDataFrame([(" DDI ",)], "source_dataset string"))


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(1)
    group = rng.integers(0, 1400, 4000)
    rows = [(i, int(rng.integers(0, 25)), "lighter" if rng.random() < 0.615 else "darker", f"g{g}") for i, g in enumerate(group)]
    df = spark.createDataFrame(rows, "id int, label int, band string, group_key string")
    return splits.stratified_group_split(df, label="label").checkpoint() if spark.sparkContext.getCheckpointDir() else splits.stratified_group_split(df, label="label").cache()


def test_split_invariants(split):
    splits.verify_no_leakage(split)
    n = {r["split"]: r["count"] / 4000 for r in split.groupBy("split").count().collect()}
    assert n["train"] == pytest.approx(0.7, abs=0.05) and n["validation"] == pytest.approx(0.1, abs=0.04) and n["test"] == pytest.approx(0.2, abs=0.05)
    share = [r[1] for r in split.groupBy("split").agg(F.avg((F.col("band") == "darker").cast("int"))).collect()]
    assert max(share) - min(share) < 0.03
    with pytest.raises(ValueError):
        splits.verify_no_leakage(split.withColumn("split", F.when(F.col("id") % 2 == 0, "a").otherwise("b")))


def test_group_keys_and_clusters(spark):
    df = spark.createDataFrame([("pad_ufes_20", "PAT_1", 7), ("fitzpatrick17k", None, 9), ("x", " ", 3), ("x", "None", 4)], "source_dataset string, patient_id string, dup_cluster_loose int")
    got = [tuple(r) for r in dedup.group_keys(df).select("group_key", "group_key_provenance").collect()]
    assert got == [("pad_ufes_20::patient::PAT_1", "patient"), ("fitzpatrick17k::cluster::9", "cluster"), ("x::cluster::3", "cluster"), ("x::cluster::4", "cluster")]
    hashes = spark.createDataFrame([(0, 0b0000), (1, 0b0001), (2, 0xFFFF), (3, -1), (4, -2)], "id int, h long")
    links = dedup.hamming_links(dedup.hash_classes(hashes, key="id", value="h"), most=1)
    assert sorted((r["a"], r["b"]) for r in links.collect()) == [(0, 1), (3, 4)]
    assert {r["id"]: r["cluster"] for r in dedup.clusters(hashes, links, "id", value="h").collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
    assert {r["id"]: r["cluster"] for r in dedup.clusters(hashes, links, "id").collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


def test_hash_links_count_all_pairs_through_classes(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    h = {i: base[i % 12] ^ (1 << int(rng.integers(0, 64)) if i % 3 else 0) ^ (1 << int(rng.integers(0, 64)) if i % 5 == 0 else 0) for i in range(200)}
    h = {i: v - (1 << 64) if v >= 1 << 63 else v for i, v in h.items()}
    v = {i: [float(x) for x in rng.integers(-2, 3, 3)] for i in h}
    df = spark.createDataFrame([(i, h[i], v[i]) for i in h] + [(500, None, None)], "id int, h long, v array<double>")
    near = lambda a, b: ((h[a] ^ h[b]) & ((1 << 64) - 1)).bit_count() <= 2
    got = {r["id"]: (r["class"], r["n_links"]) for r in dedup.hash_links(df, key="id", value="h", most=2).collect()}
    assert got == {i: (min(j for j in h if h[j] == h[i]), sum(near(i, j) for j in h if j != i)) for i in h}

    def cosine(x, y):
        n = math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
        return sum(a * b for a, b in zip(x, y, strict=True)) / n if n else 0.0

    alike = lambda a, b: (h[a] == h[b] and v[a] == v[b]) or (near(a, b) and cosine(v[a], v[b]) >= 0.79)
    got = {r["id"]: (r["class"], r["n_links"]) for r in dedup.hash_and_vector_links(df, key="id", value="h", vector="v", most=2, least=0.79).collect()}
    assert got == {i: (min(j for j in h if h[j] == h[i] and v[j] == v[i]), sum(alike(i, j) for j in h if j != i)) for i in h}
    for block in (2, 4096):
        found = dedup.cosine_search(df, df.filter("id % 40 = 0 OR id = 500"), key="id", vector="v", least=0.79, block=block).collect()
        assert {(r["a"], r["b"]) for r in found} == {(a, b) for a in h if a % 40 == 0 for b in h if a != b and cosine(v[a], v[b]) >= 0.79}
    assert dedup.cosine_search(df, df.limit(0), key="id", vector="v", least=0.8).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (None, 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}


def test_sampling(spark, tmp_path):
    rows = [(c, b) for c in range(25) for b, n in (("lighter", 537), ("darker", 335)) for _ in range(n)]
    pool = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, disease_label int, band string")
    assert sampling.max_feasible_n(pool).first()["max_n"] == 670
    balanced = sampling.composition(sampling.sample_training_set(pool, 600, "balanced", row_id="id")).first()
    natural = sampling.composition(sampling.sample_training_set(pool, 600, "natural", row_id="id")).first()
    assert tuple(balanced) == (15000, 50.0) and natural["n_rows"] == 15000 and natural["darker_percent"] == pytest.approx(38.4, abs=1.5)
    for n, rule in ((671, "balanced"), (None, "natural"), (5, "odd")):
        with pytest.raises(ValueError):
            sampling.sample_training_set(pool, n, rule, row_id="id")
    rungs = workflows.sample_ablations(pool, 600, row_id="id")
    assert set(rungs) == set(sampling.LADDER)
    workflows.write_ablations({k: rungs[k] for k in ("A1", "A5")}, str(tmp_path), 600)
    manifest = {r["setting"]: r for r in spark.read.json(f"{tmp_path}/ablation_manifest").collect()}
    assert manifest["A1"]["n_rows"] == 15000 and manifest["A5"]["colour_constancy"] and spark.read.parquet(f"{tmp_path}/train").groupBy("setting").count().count() == 2


def test_evaluation_and_bootstrap(spark, tmp_path):
    df = predictions.synthetic(spark, n=400, n_classes=4, n_groups=80, settings=("A1", "A2"), seeds=(1, 2)).cache()
    out = workflows.evaluate(df, n_boot=20)
    point = out["metrics"].collect()
    assert len(workflows.write(out, str(tmp_path))) == 5 and spark.read.csv(f"{tmp_path}/ablation_comparisons", header=True).count() == 1
    assert len(point) == 4 and all(0 <= r["auroc"] <= 1 and r["abs_delta"] == abs(r["delta"]) for r in point)
    assert out["table"].count() == 2 and out["intervals"].first()["low"] <= out["intervals"].first()["high"]
    test = out["comparisons"].collect()
    assert len(test) == 1 and test[0]["treatment"] == "A2" and 0 <= test[0]["p_holm"] <= 1
    rng = np.random.default_rng(0)
    pos, score = rng.random(200) < 0.4, rng.integers(0, 20, 200).astype(float)
    brute = np.mean([(a > b) + 0.5 * (a == b) for a in score[pos] for b in score[~pos]])
    assert bootstrap.weighted_auroc(pos, score, np.ones((1, 200)))[0] == pytest.approx(brute)
    flat = spark.createDataFrame([(1, bool(p), float(s)) for p, s in zip(pos, score, strict=True)], "run int, pos boolean, s double")
    assert metrics.binary_auroc(flat, by=["run"], score="s", positive="pos").first()["auroc"] == pytest.approx(brute)
    external = workflows.external_test(df.withColumn("fst_group", F.element_at(F.array(*[F.lit(x) for x in metrics.EXTERNAL]), (F.col("row_id") % 3 + 1).cast("int"))))
    assert external.count() == 2


def test_auroc_of_any_scores(spark):
    rng = np.random.default_rng(3)
    score = np.concatenate([rng.normal(size=150), rng.normal(size=50) * 1e-9, rng.integers(-3, 3, 60), [0.0, -0.0, np.inf, -np.inf, 1e300, -1e300, 0.5, 0.5]])
    score = np.round(score, 2) * np.where(rng.random(len(score)) < 0.5, 1, 1.0)
    pos = rng.random(len(score)) < 0.4
    weight = rng.integers(0, 4, len(score)).astype(float)
    df = spark.createDataFrame([(None if i % 2 else 1, bool(p), float(s), float(w)) for i, (p, s, w) in enumerate(zip(pos, score, weight, strict=True))], "run int, pos boolean, s double, w double")

    def brute(some, w):
        pairs = [(w[i] * w[j], (score[i] > score[j]) + 0.5 * (score[i] == score[j])) for i in some if pos[i] for j in some if not pos[j]]
        return sum(a * b for a, b in pairs) / sum(a for a, _ in pairs)

    every = range(len(score))
    ones = np.ones(len(score))
    assert metrics.binary_auroc(df, by=[], score="s", positive="pos").first()["auroc"] == pytest.approx(brute(every, ones))
    assert metrics.binary_auroc(df, by=[], score="s", positive="pos", weight="w").first()["auroc"] == pytest.approx(brute(every, weight))
    got = {r["run"]: r["auroc"] for r in metrics.binary_auroc(df, by=["run"], score="s", positive="pos").collect()}
    assert got == {None: pytest.approx(brute(every[1::2], ones)), 1: pytest.approx(brute(every[::2], ones))}
    plan = metrics.binary_auroc(df, by=["run"], score="s", positive="pos")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_both_ways_of_replicates_agree(spark):
    df = predictions.synthetic(spark, n=300, n_classes=4, n_groups=60, settings=("A1", "A2"), seeds=(1,)).cache()
    weights, by, classes = bootstrap.group_weights(df, 70), ["setting", "seed"], metrics.common_classes(df)
    one, other = ({(r["setting"], r["rep"]): r["delta"] for r in bootstrap.delta_replicates(df, weights, by=by, classes=classes, most_rows=most).collect()} for most in (10**6, 10))
    assert len(one) == 140 and one.keys() == other.keys() and all(one[k] == pytest.approx(other[k], abs=1e-9) for k in one)


def test_contrastive_loss_by_batches(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 10, 4))
    df = spark.createDataFrame([(i, i // 6, x[i].tolist(), y[i].tolist()) for i in range(10)], "id int, batch int, image array<double>, text array<double>")
    got = {r["batch"]: (r["n"], r["loss"]) for r in metrics.contrastive_loss(df).collect()}
    for batch, some in ((0, slice(0, 6)), (1, slice(6, 10))):
        a, b = (m[some] / np.linalg.norm(m[some], axis=1, keepdims=True) for m in (x, y))
        s = a @ b.T / 0.07
        want = np.mean([np.mean(np.log(np.exp(s).sum(axis=k)) - np.diag(s)) for k in (0, 1)])
        assert got[batch] == (len(a), pytest.approx(want))


def test_split_keeps_rows_and_refuses_bad_input(spark):
    rows = [(i, None if i % 7 == 0 else "a", None if i % 5 == 0 else "lighter", f"g{i % 90}") for i in range(900)]
    df = spark.createDataFrame(rows, "id int, label string, band string, group_key string")
    for shards in (1, 4):
        out = splits.stratified_group_split(df, label="label", shards=shards)
        assert out.count() == 900 and splits.leaking_groups(out).count() == 0 and {r[0] for r in out.select("split").distinct().collect()} == set(splits.SPLITS)
    with pytest.raises(ValueError, match="without a group_key"):
        splits.stratified_group_split(df.withColumn("group_key", F.when(F.col("id") > 3, F.col("group_key"))), label="label")
    for fractions in ((0.7, 0.1, 0.1), (0.7, 0.3, 0.0), (0.1, 0.1, 0.8), (0.5, 0.5)):
        with pytest.raises(ValueError):
            splits.folds(fractions)
    assert splits.folds((0.7, 0.1, 0.2)) == (5, 8)


def test_drawn_rows_come_in_an_order_of_their_own(spark):
    pool = spark.createDataFrame([(i, i % 2, "lighter") for i in range(200)], "id int, disease_label int, band string")
    drawn = [tuple(r) for r in sampling.sample_training_set(pool, 50, "natural", row_id="id").select("id", "disease_label").collect()]
    assert drawn == [tuple(r) for r in sampling.sample_training_set(pool.repartition(3), 50, "natural", row_id="id").select("id", "disease_label").collect()]
    classes = [c for _, c in drawn]
    assert 20 < sum(a != b for a, b in zip(classes, classes[1:], strict=False)) and [i for i, _ in drawn] != sorted(i for i, _ in drawn)


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "A1_seed7.npz", probs=np.full((3, 2), 0.5, np.float32), y_true=np.array([0, 1, 0]), band=np.array(["lighter", "darker", "darker"]), group=np.array([1, 2, 3]))
    (tmp_path / "other.npz").write_bytes(b"no")
    got = predictions.load_archives(spark, str(tmp_path)).collect()
    assert len(got) == 3 and got[0]["setting"] == "A1" and got[0]["seed"] == 7 and got[0]["probs"] == [0.5, 0.5]


def test_archives_are_written_and_read_back(spark, tmp_path):
    df = predictions.synthetic(spark, n=40, n_classes=3, n_groups=9, settings=("A1", "A2"), seeds=(1,))
    assert sinks.write_archives(df, str(tmp_path)) == ["A1_seed1.npz", "A2_seed1.npz"]
    back = predictions.load_archives(spark, str(tmp_path))
    key = lambda some: {(r["setting"], r["seed"], r["row_id"]): (r["y_true"], r["band"], r["group"], [float(np.float32(p)) for p in r["probs"]]) for r in some.collect()}
    assert key(back) == key(df)
    (tmp_path / "external").mkdir()  # an external archive has a group of its own and no band
    np.savez(tmp_path / "external" / "A3_seed4.npz", probs=np.full((2, 2), 0.5), y_true=np.array([0, 1]), fst_group=np.array(["I-II", "V-VI"]))
    assert sorted(r["band"] for r in predictions.load_archives(spark, str(tmp_path / "external"), "fst_group").collect()) == ["I-II", "V-VI"]


def test_feature_archives_and_image_text(spark, tmp_path):
    rng = np.random.default_rng(4)
    for variant, parts in (("class_name", ("train", "test")), ("template", ("train",))):
        for part in parts:
            label = np.arange(60) % 3
            band = {"band": np.where(np.arange(60) % 2, "lighter", "darker")} if part == "test" else {}
            np.savez(tmp_path / f"{variant}_{part}.npz", features=rng.normal(size=(60, 4)) + label[:, None] * np.array([3.0, 0, -3, 1]), labels=label, **band)
    rows = predictions.load_feature_archives(spark, str(tmp_path))
    assert rows.count() == 120 and {r[0] for r in rows.select("variant").distinct().collect()} == {"class_name"}
    found = workflows.image_text(rows).first()
    assert found["variant"] == "class_name" and found["auroc"] > 0.95
    made = workflows.write({"image_text": workflows.image_text(rows)}, str(tmp_path / "out"))
    assert spark.read.json(made[0]).count() == 1


def test_image_hash(spark):
    ramp = np.tile(np.arange(0, 180, 5, dtype=np.uint8)[None, :, None], (20, 1, 3))
    rows = [(1, 36, 20, ramp.tobytes()), (2, 36, 20, ramp[:, ::-1].tobytes()), (3, 9, 8, np.full((8, 9, 3), 7, np.uint8).tobytes()), (4, 5, 5, b"short"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id int, w int, h int, rgb binary").select("id", dedup.image_hash(F.col("w"), F.col("h"), F.col("rgb")).alias("hash"))
    assert {r["id"]: r["hash"] for r in df.collect()} == {1: -1, 2: 0, 3: 0, 4: None, 5: None}
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (8, 9, 3))
    grey = np.rint(image @ np.array([0.299, 0.587, 0.114]))
    assert (dedup.grey_grid(image) == grey).all()  # of its own size already
    small, large = dedup.grey_grid(np.kron(image, np.ones((7, 7, 1)))), grey
    assert np.abs(small - large).mean() < 30  # each cell is mostly its own block


def test_presets(spark):
    rows = sampling.training_presets(spark).collect()
    assert len(rows) == 14 and {(r["backbone"], r["learning_rate"], r["batch_size"]) for r in rows} == {("vit_b_16", 5e-5, 16), ("resnet50", 1e-4, 32)}
    assert {r["setting"] for r in rows if r["tone_weighted_loss"]} == {"A6"}


def test_p_values_and_intervals(spark):
    from tessera.operators import audit

    df = spark.createDataFrame([("lighter", "a")] * 30 + [("lighter", "b")] * 10 + [("darker", "a")] * 15 + [("darker", "b")] * 25, "band string, category string")
    row = audit.category_association(df).first()
    assert row["dof"] == 1 and row["p"] == pytest.approx(stats.chi2_tail(row["chi2"], 1)) and 0 < row["p"] < 0.01
    assert audit.category_association(df.filter("category = 'a'")).first()["p"] == 1.0
    with pytest.raises(ValueError, match="levels"):
        audit.category_association(spark.range(1500).select(F.lit("x").alias("band"), F.col("id").alias("category")))
    trend = spark.createDataFrame([(k, "malignant" if i < 10 + 2 * k + k % 2 else "benign") for k in range(1, 7) for i in range(100)], "fitzpatrick int, category string")
    got = audit.malignant_trend(trend).first()
    assert got["low"] < got["slope"] < got["high"] and got["high"] - got["slope"] == pytest.approx(2.776445 * got["stderr"], abs=1e-5) and got["p"] < 0.01


def test_reports_and_captions(spark, tmp_path):
    df = spark.createDataFrame([("c1", "tinea corporis", "Forearm")], "id string, label string, site string")
    df = reports.build_report(df, {"case_id": F.col("id"), "disease_label": F.col("label"), "analysis_band": F.lit("darker"), "anatomical_site": F.col("site")})
    reports.validate(df)
    assert df.select(captions.template_caption(F.col("report"))).first()[0] == "A clinical photograph showing tinea corporis on the forearm."
    assert set(df.select(captions.verified(F.col("report"))).first()[0]) == {"case_id", "disease_label", "analysis_band", "anatomical_site"}
    assert reports.coverage(df).count() == 17
    said = {
        "Tinea corporis on the face": "unsupported_site: 'face'", "A 40-year-old with tinea corporis": "forbidden_age: '40-year-old'", "Tinea corporis, treated with therapy": "forbidden_treatment: 'therapy'",
        "Tinea with a scaly plaque": "unsupported_descriptor: 'scaly'", "Psoriasis": "diagnosis_not_stated_or_changed", "tinea on pale skin": "unsupported_skin_tone: 'pale'",
        "Tinea. Caucasian patient": "forbidden_ethnicity: 'caucasian patient'", "Tinea, biopsy confirmed": "forbidden_unsupported_certainty: 'biopsy confirmed'",
    }
    fine = ["Tinea corporis on the forearm without a plaque", "tinea, no sign of therapy", "tinea of the FOREARM", "corporis: not a man"]
    rows = df.crossJoin(spark.createDataFrame([(t,) for t in [*said, *fine]] + [(None,)], "caption string"))
    got = {r["caption"]: r["violations"] for r in captions.check_captions(rows).collect()}
    assert all(v in got[t] for t, v in said.items()) and all(got[t] == [] for t in fine), got
    assert got[None] == ["diagnosis_not_stated_or_changed"]
    assert got["A 40-year-old with tinea corporis"] == ["forbidden_age: '40-year-old'"]
    crohn = reports.build_report(spark.range(1), {"disease_label": F.lit("Crohn's"), "anatomical_site": F.lit("leg/foot")}).withColumn("caption", F.lit("crohn on the foot, not of the face but the arm"))
    # The apostrophe does not cut a word; "face" is two words after "not", "arm" is five after it.
    assert captions.check_captions(crohn).first()["violations"] == ["diagnosis_not_stated_or_changed", "unsupported_site: 'arm'"]
    assert captions.check_captions(crohn, synonyms={"crohn's": ["crohn"]}).first()["violations"] == ["unsupported_site: 'arm'"]
    assert captions.generate_captions(df, lambda ask: "  tinea corporis\n", key="id").first()["caption"] == "tinea corporis"
    bad = captions.generate_captions(df, lambda ask: "psoriasis on the face", key="id").first()
    assert [len(a["violations"]) for a in json.loads(bad["attempts"])] == [2, 2]
    again = captions.generate_captions(df, lambda ask: "tinea corporis" if "broke these rules" in ask else "psoriasis", key="id").first()

    def failing(ask):
        raise RuntimeError("down")

    assert (bad["route"], bad["flagged"]) == ("template_fallback", True) and again["route"] == "lm_regenerated"
    assert captions.generate_captions(df, failing, key="id").first()["route"] == "template_fallback"
    sinks.write_bundle({"coverage": reports.coverage(df)}, str(tmp_path / "bundle"))
    assert sinks.supplements({"S1": reports.rules(spark)}, str(tmp_path)) == ["S2", "S3", "S4", "S5", "S6"]
    reports.write_schema(str(tmp_path / "schema.json"))


def test_corpus(spark, tmp_path):
    rows = [("a", "foo", f"p{i % 40}", "lighter" if i % 3 else "darker") for i in range(200)] + [("a", "junk", "p1", "lighter")]
    manifest = spark.createDataFrame(rows, "source_dataset string, source_label string, patient_id string, band string")
    table = spark.createDataFrame([("a", "foo", "foo", "x", "exact", None, None, 0, None)], labels.MAP_SCHEMA).withColumn("excluded", F.col("excluded") == 1)
    out = workflows.build_corpus(manifest, table)
    assert out["corpus"].count() == 200 and out["splits"].count() == 4
    workflows.write(out, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/corpus").filter("split = 'train'").count() > 100 and spark.read.json(f"{tmp_path}/supplement_field_coverage").count() == 17
    assert sinks.read_corpus(spark, f"{tmp_path}/corpus").select("disease_label").first()[0] == "foo"
    sinks.write_table(out["corpus"], f"{tmp_path}/as_csv", kind="csv")
    assert sinks.read_corpus(spark, f"{tmp_path}/as_csv", "test", kind="csv").count() == sinks.read_corpus(spark, f"{tmp_path}/corpus", "test").count()


def test_colour(spark):
    rng = np.random.default_rng(0)
    rows = [(1, float(a), float(b), float(c)) for a, b, c in rng.random((200, 3)) * [0.9, 0.5, 0.5]] + [(2, 0.5, 0.5, 0.5)] * 20 + [(3, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "image_id int, r double, g double, b double")
    light = {r["image_id"]: np.array(r[1:]) for r in colour.illuminant(df).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in light.values()) and light[1][0] > light[1][1]
    fixed = colour.shades_of_gray(df).groupBy("image_id").agg(*[F.avg(c).alias(c) for c in "rgb"]).collect()
    by = {r["image_id"]: r for r in fixed}
    assert abs(by[1]["r"] - by[1]["g"]) < 0.06 and by[2]["r"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        colour.as_unit(df.drop("b"))


def test_bootstrap_set_is_counted_before_it_is_collected(spark):
    rows = spark.range(5).toDF("y_true")
    assert len(bootstrap.collected(rows, 5)) == 5
    with pytest.raises(ValueError, match="more than the 4"):
        bootstrap.collected(rows, 4)
