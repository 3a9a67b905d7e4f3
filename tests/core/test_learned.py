import numpy as np

from sluice.operators import ml
from sluice.plans import learned, registry
from sluice.plans.relations import reached


def brute(x, cut):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near, label = unit @ unit.T >= cut, np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[row].min() for row in near])
    return {i: int(label[i]) for i in range(len(x)) if near[i].sum() > 1}


def test_clusters_join_vectors_that_are_no_queries(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 16))
    x[1:10] = x[1] + rng.normal(0, 0.01, (9, 16))  # none of them a fiftieth vector, and more than five others
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    cut = learned._ask(spark, str(tmp_path), "sim_level").first()["cut"]
    got = {r["node"]: r["cluster"] for r in learned.shadow_cluster(spark, str(tmp_path)).collect()}
    assert got == brute(x, cut) and {got[i] for i in range(1, 10)} == {got[1]}


def test_links_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ml, "BLOCK", 16)
    x = np.random.default_rng(6).normal(0, 1, (90, 4))
    vectors = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(90)] + [(90, [0.0] * 4)], "id long, v array<double>").repartition(3)
    got = {r["node"]: r["component"] for r in learned.components(ml.links_at(vectors, 0.9)).collect()}
    assert got == brute(x, 0.9)


def test_shadow_pipeline_answers_every_wallet(spark, sf):
    some = learned._ask(spark, sf, "fingerprints").where("event_count >= 3")
    vectors = {r["wallet"]: np.array(r["embedding"]) for r in ml.embed(some, learned.BEHAVIOUR, "wallet").collect()}
    names = sorted(vectors)
    x = np.array([vectors[n] for n in names])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    sim = unit @ unit.T
    cut = np.percentile(sim[np.triu_indices(len(x), 1)], 99.5)
    got = learned.shadow_pipeline(spark, sf).collect()
    want = {names[i] for i in range(len(x)) if (np.delete(sim[i], i) >= cut - 1e-12).any()}
    assert {r["wallet"] for r in got} == want and min(r["sim"] for r in got) >= round(cut, 4)
    label = brute(x, cut - 1e-12)
    assert {r["wallet"]: r["cluster"] for r in got} == {names[i]: names[c] for i, c in label.items()}


def test_every_labelled_row_is_tested_once(spark, sf, monkeypatch):
    forest, asked = ml._forest, []
    monkeypatch.setattr(ml, "_forest", lambda rows, trees, depth: asked.append(trees) or forest(rows, 2, depth))
    got = learned.nested_cv(spark, sf).collect()
    assert sorted(r["fold"] for r in got) == [0, 1, 2, 3, 4] and set(asked) == {150}
    assert sum(r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in got) == learned._labelled(spark, sf).count()


def test_registered_models_have_all_trees(spark, sf, monkeypatch):
    classifier, asked = ml._classifier, []
    monkeypatch.setattr(ml, "_classifier", lambda kind, trees: asked.append((kind, trees)) or classifier(kind, 2))
    learned.ensemble_wide(spark, sf).count()
    learned.elliptic_bench(spark, sf).count()
    assert asked == [("boosted", 200), ("deep", 200), ("forest", 100)] * 2


def test_figures_against_plain_counts(spark):
    rng = np.random.default_rng(8)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 41, 300) / 40
    got = ml.binary_figures(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "label double, p double")).first()
    ones, zeros = p[y == 1], p[y == 0]
    assert np.isclose(got["auroc"], ((ones[:, None] > zeros).sum() + (ones[:, None] == zeros).sum() / 2) / (len(ones) * len(zeros)))
    want, before = 0.0, 0
    for cut in sorted(set(p), reverse=True):
        want, before = want + ((ones >= cut).sum() - before) / len(ones) * (ones >= cut).sum() / (p >= cut).sum(), (ones >= cut).sum()
    bins = np.maximum(np.ceil(np.round(p * 10, 5)), 1)
    ece = sum(abs(p[bins == b].mean() - y[bins == b].mean()) * (bins == b).mean() for b in set(bins))
    assert np.isclose(got["auprc"], want) and np.isclose(got["ece"], ece) and np.isclose(got["brier"], ((p - y) ** 2).mean())
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == ((ones >= 0.4).sum(), (zeros >= 0.4).sum(), (ones < 0.4).sum(), (zeros < 0.4).sum())
    none = ml.binary_figures(spark.createDataFrame([(1.0, 0.5)], "label double, p double")).first()
    assert none["auroc"] is None and none["auprc"] == 1.0


def test_levels_of_the_ensemble(spark):
    rows = [("a", 70.0, 0.95, 1), ("b", 69.99, 0.95, 0), ("c", 50.0, 0.9, 1), ("d", 49.9, 0.99, 1), ("e", 29.0, 0.0, 0)]
    got = {r["id"]: (r["level"], r["mule_type"]) for r in learned.levels_of(spark.createDataFrame(rows, "id string, score double, forwarding_ratio double, rapid_transfer int")).collect()}
    assert got == {"a": ("CRITICAL", "WILLING"), "b": ("HIGH", "UNWITTING"), "c": ("MEDIUM", "UNWITTING"), "d": ("LOW", "N/A"), "e": ("CLEAR", "N/A")}


def test_models_reach_levels_and_sinks(spark, sf, monkeypatch):
    classifier = ml._classifier
    monkeypatch.setattr(ml, "_classifier", lambda kind, trees: classifier(kind, 2))
    levels = learned.ensemble_levels(spark, sf)
    assert levels.count() == learned._ask(spark, sf, "all_accounts").count() and {"level", "action", "flags"} <= set(levels.columns)
    found = {r["model"]: r for r in learned.sink_elliptic_results(spark, sf).collect()}
    assert set(found) == {"boosted", "deep", "forest", "isolation"}
    assert len({r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in found.values()}) == 1 and all(0 <= r["f1"] <= 1 for r in found.values())


def test_features_of_accounts_are_worked_out_once(spark, sf, monkeypatch):
    """Models, oddness, levels and flags read one table; relay events, of which a column only has the name, aren't derived for it."""
    monkeypatch.setattr(registry, "_MEMOS", {})
    classifier = ml._classifier
    monkeypatch.setattr(ml, "_classifier", lambda kind, trees: classifier(kind, 2))
    want = {r["id"]: r for r in learned._ask(spark, sf, "acct_features").collect()}
    levels = learned.ensemble_levels(spark, sf)
    assert "sender_id" not in levels._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r for r in learned._of_accounts(spark, sf, "acct_features").collect()} == want == {r["id"]: want[r["id"]] for r in levels.collect()}
    (memo,) = registry._MEMOS.values()
    assert set(memo) == {"transfers", "feature_rows"} and "relay" not in reached("rule_risk") and "relay" in reached("unique_ips")


def test_boosted_trees_see_equal_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (900, 2))
    data = [(i, float(a), float(b), int(a + b + rng.integers(0, 3) > 4)) for i, (a, b) in enumerate(x.tolist())]
    rows = spark.createDataFrame(data, "id long, a double, b double, label int").repartition(3)
    seen, fit = [], ml.GBTClassifier._fit
    monkeypatch.setattr(ml.GBTClassifier, "_fit", lambda self, of: seen.append(of.count()) or fit(self, of))
    models = ml.train_ensemble(rows, ["a", "b"], (6, 6, 3))
    assert seen == [len({r[1:] for r in data})] * 2
    ones = sum(r[3] for r in data)
    whole = rows.selectExpr("*", f"IF(label = 1, {900 / (2 * ones)}D, {900 / (2 * (900 - ones))}D) AS weight")
    stages = [ml.VectorAssembler(inputCols=["a", "b"], outputCol="raw", handleInvalid="keep"), ml.StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    plain = [ml.Pipeline(stages=[*stages, ml._classifier(kind, n).setWeightCol("weight")]).fit(whole) for kind, n in (("boosted", 6), ("deep", 6), ("forest", 3))]
    got, want = ({r["id"]: r["score"] for r in ml.predict_ensemble(m, rows, "id").collect()} for m in (models, plain))
    assert got.keys() == want.keys() and all(np.isclose(got[i], want[i]) for i in want) and len(set(got.values())) > 5


def test_wide_table_and_its_list(spark, sf):
    wide = learned.src_wide_features(spark, sf)
    assert [r["feature"] for r in learned.src_feature_list(spark, sf).collect()] == learned.ACCOUNT == wide.columns[1:-1]
    assert wide.count() == learned._labelled(spark, sf).count()


def test_copies_and_one_large_component_need_few_comparisons(spark, monkeypatch):
    """Rows beyond the first block are held against others only where they aren't in the large component, and once for all copies."""
    monkeypatch.setattr(ml, "BLOCK", 16)
    rng = np.random.default_rng(13)
    x = np.concatenate([np.array([9.0, 0, 0, 0]) + rng.normal(0, 1, (300, 4)), np.array([0, 9.0, 0, 0]) + rng.normal(0, 0.5, (8, 4)), rng.normal(0, 1, (6, 4))])
    x = np.concatenate([x, np.repeat(x[-3:], 40, axis=0)])
    asked, whole = [], ml._forest_links
    monkeypatch.setattr(ml, "_forest_links", lambda block, rows, cut: asked.append(len(block)) or whole(block, rows, cut))
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(999, [0.0] * 4), (1000, [0.0] * 4)], "id long, v array<double>").repartition(3)
    got = {r["node"]: r["component"] for r in learned.components(ml.links_at(vectors, 0.95)).collect()}
    assert got == brute(x, 0.95) and sum(asked) < 100
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    compared, near = [], ml.neighbours_of
    monkeypatch.setattr(ml, "neighbours_of", lambda q, r, k: compared.append(q.count()) or near(q, r, k))
    found = {}
    for r in sorted(ml.nearest_others(vectors, 5, 0.95).collect(), key=lambda r: (-round(r["sim"], 12), r["other"])):
        found.setdefault(r["id"], []).append(r["other"])
    want = {}
    for i in range(len(x)):
        order = sorted((-round(float(s), 12), j) for j, s in enumerate(unit @ unit[i]) if j != i and s >= 0.95)
        if order:
            want[i] = [j for _, j in order[:5]]
    assert found == want and compared == [len(np.unique(x, axis=0)) + 1]


def test_similarity_cut_is_that_of_all_pairs(spark, monkeypatch):
    """More rows than any draw, in several blocks, with copies and a vector of length 0: the percentile of all pairs, and none of fewer than two rows."""
    monkeypatch.setattr(ml, "BLOCK", 700)
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(0, 1, (2400, 4)), np.repeat(rng.normal(0, 1, (20, 4)), 12, axis=0), np.zeros((2, 4))])
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(9999, None)], "id long, v array<double>").repartition(3)
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    sim = (unit @ unit.T)[np.triu_indices(len(x), 1)]
    for share in (0.995, 0.5, 0.0, 1.0):
        assert np.isclose(ml.similarity_cut(vectors, share), np.percentile(sim, 100 * share), rtol=0, atol=1e-13), share
    assert ml.similarity_cut(vectors.where("id < 1")) is None and ml.similarity_cut(vectors.where("id < 2")) == ml.similarity_cut(vectors.where("id < 2"), 0.0)
    assert ml._keys(np.array([-1.0, -0.5, -0.0, 0.0, 1e-300, 1.0, np.nan])).argsort(kind="stable").tolist() == [*range(7)] and ml._cosine(int(ml._keys(np.array([-0.25]))[0])) == -0.25


def test_shadow_account_is_judged_by_all_pairs(spark, monkeypatch):
    """The threshold that a wallet's look-alikes must reach is that of all wallets, more than any draw would have."""
    rng = np.random.default_rng(16)
    rows = [(f"w{i}" if i else "wp0_0", 3, *[float(v) for v in rng.normal(0, 1, 7)]) for i in range(2300)]
    rows[1] = ("w1", 3, *[v + 0.01 for v in rows[0][2:]])
    prints = spark.createDataFrame(rows, "wallet string, event_count long, " + ", ".join(f"{c} double" for c in learned.BEHAVIOUR[1:]))
    monkeypatch.setattr(learned, "_ask", lambda spark, sf_dir, name: prints)
    cuts, whole = [], ml.nearest_others
    monkeypatch.setattr(ml, "nearest_others", lambda v, k, cut: cuts.append(cut) or whole(v, k, cut))
    got = {r["match"] for r in learned.shadow_account(spark, "").collect()}
    vectors = {r["wallet"]: np.array(r["embedding"]) for r in ml.embed(prints, learned.BEHAVIOUR, "wallet").collect()}
    names = sorted(vectors)
    x = np.array([vectors[n] for n in names])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    sim = unit @ unit.T
    want = np.percentile(sim[np.triu_indices(len(x), 1)], 99.5)
    own = names.index("wp0_0")
    near = [i for i in np.argsort(-sim[own])[:6] if i != own and sim[own, i] >= want]
    assert np.isclose(cuts[0], want, rtol=0, atol=1e-12) and got == {names[i] for i in near} and "w1" in got
