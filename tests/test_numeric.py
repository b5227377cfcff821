"""Operators against numpy, and properties that hold for any input."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.operators import evaluate, fisher, gmm, pca, retrieve
from kinfold.plans import pipeline

RNG = np.random.default_rng(1)


def table(spark, x, **columns):
    rows = [(i, *(c[i] for c in columns.values()), [float(v) for v in x[i]]) for i in range(len(x))]
    kinds = ", ".join(f"{k} {'long' if isinstance(v[0], int) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame(rows, f"i long, {kinds + ', ' if kinds else ''}v array<double>")


def test_pca_matches_numpy_and_whitens(spark):
    x = RNG.normal(size=(200, 6)) @ RNG.normal(size=(6, 6))
    df = table(spark, x)
    model = pca.fit(df, 6, "v")
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(model.variances, values)
    got = np.array([r["reduced"] for r in pca.transform(df, model, "v").orderBy("i").collect()])
    assert np.allclose(np.cov(got.T), np.eye(6), atol=1e-9)
    assert np.allclose(model.ratios.sum(), 1)
    assert pca.optimal_components(model, 2.0) == 7
    back = pca.PCAModel.from_rows(model.to_rows(spark))
    assert np.allclose(back.loadings, model.loadings) and np.allclose(back.mean, model.mean)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_results_do_not_depend_on_partitions(spark, parts):
    x = np.random.default_rng(3).normal(size=(64, 4))
    df = table(spark, x).repartition(parts)
    model = pca.fit(df, 3, "v")
    ref = pca.fit(table(spark, x).coalesce(1), 3, "v")
    assert np.allclose(model.loadings, ref.loadings, atol=1e-9)
    start = gmm.GMMModel(np.full(2, 0.5), x[:2], np.ones((2, 4)))
    step, _ = gmm.em_step(df, start, "v")
    other, _ = gmm.em_step(table(spark, x).coalesce(1), start, "v")
    assert np.allclose(step.means, other.means, atol=1e-9)


def test_pca_rejects_too_many_components(spark):
    with pytest.raises(ValueError):
        pca.fit(table(spark, RNG.normal(size=(3, 4))), 4, "v")
    with pytest.raises(ValueError):
        pca.fit(table(spark, RNG.normal(size=(3, 4))).where("false"), 1, "v")


def test_em_increases_likelihood_and_separates(spark):
    x = np.concatenate([RNG.normal(-5, 0.5, (80, 3)), RNG.normal(5, 0.5, (40, 3))])
    df = table(spark, x)
    model, last = gmm.initial(df, 2, vec="v"), -np.inf
    for _ in range(4):
        model, now = gmm.em_step(df, model, "v")
        assert now >= last - 1e-6
        last = now
    fitted = gmm.fit(df, 2, vec="v")
    assert sorted(np.round(fitted.weights, 2)) == [0.33, 0.67]
    gamma = np.array([r["gamma"] for r in gmm.responsibilities(df, fitted, "v").collect()])
    assert np.allclose(gamma.sum(axis=1), 1)


def reference_fisher(x, m):
    joint = np.log(m.weights) - 0.5 * (np.log(2 * np.pi * m.variances).sum(1) + ((x[:, None] - m.means) ** 2 / m.variances).sum(2))
    g = np.exp(joint - joint.max(1, keepdims=True))
    g /= g.sum(1, keepdims=True)
    a = [(g[:, [k]] * (x - m.means[k]) / np.sqrt(m.variances[k])).sum(0) for k in range(len(m.weights))]
    b = [(g[:, [k]] * ((x - m.means[k]) ** 2 - m.variances[k]) / (2 * m.variances[k] ** 1.5)).sum(0) for k in range(len(m.weights))]
    f = np.concatenate(a + b)
    f = np.sign(f) * np.sqrt(np.abs(f))
    return f / np.linalg.norm(f)


def test_fisher_vectors_match_numpy_and_ignore_duplication(spark):
    x = RNG.normal(size=(30, 5))
    bag = [f"b{i % 4}" for i in range(30)]
    m = gmm.GMMModel(np.array([0.3, 0.7]), RNG.normal(size=(2, 5)), np.abs(RNG.normal(size=(2, 5))) + 0.1)
    df = table(spark, x, image_id=bag)
    once = {r["image_id"]: np.array(r["fv"]) for r in fisher.fisher_vectors(df, m, vec="v").collect()}
    twice = {r["image_id"]: np.array(r["fv"]) for r in fisher.fisher_vectors(df.union(df), m, vec="v").collect()}
    for b in set(bag):
        want = reference_fisher(x[[k == b for k in bag]], m)
        assert len(once[b]) == 2 * 2 * 5
        assert np.allclose(once[b], want, atol=1e-10) and np.allclose(twice[b], want, atol=1e-10)


def test_hot_bag_is_added_up_over_partitions(spark):
    x = RNG.normal(size=(500, 2))
    m = gmm.GMMModel(np.array([1.0]), np.zeros((1, 2)), np.ones((1, 2)))
    df = table(spark, x, image_id=["hot"] * 500).repartition(16)
    got = fisher.fisher_vectors(df, m, vec="v").collect()
    assert len(got) == 1 and np.allclose(got[0]["fv"], reference_fisher(x, m))


def test_zero_single_and_empty_bags(spark):
    m = gmm.GMMModel(np.array([1.0]), np.zeros((1, 2)), np.ones((1, 2)))
    rows = [("one", [1.0, 2.0]), ("null", None)]
    df = spark.createDataFrame(rows, "image_id string, v array<double>")
    assert [r["image_id"] for r in fisher.fisher_vectors(df, m, vec="v").collect()] == ["one"]
    catalog = spark.createDataFrame([("one",), ("none",), ("null",)], "image_id string")
    assert sorted(r["image_id"] for r in fisher.skipped(catalog, fisher.fisher_vectors(df, m, vec="v")).collect()) == ["none", "null"]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "image_id string, identity string, fv array<double>")


def test_top_k_ties_zero_vectors_and_small_galleries(spark):
    gallery = vectors(spark, [("a", "x", [1.0, 0.0]), ("b", "y", [2.0, 0.0]), ("z", "q", [0.0, 0.0]), ("n", "q", None)])
    probes = vectors(spark, [("p", "x", [3.0, 0.0]), ("zero", "x", [0.0, 0.0])])
    got = retrieve.top_k(probes, gallery, 5).orderBy("rank").collect()
    assert [(r["query_id"], r["gallery_id"], r["similarity"]) for r in got] == [("p", "b", 1.0), ("p", "a", 1.0)]
    assert retrieve.top_k(probes.where("false"), gallery, 5).count() == 0
    assert retrieve.top_k(probes, gallery.where("false"), 5).count() == 0


def test_query_blocks_give_the_same_result(spark):
    x = RNG.normal(size=(60, 8))
    df = vectors(spark, [(f"{i:03}", str(i % 5), [float(v) for v in x[i]]) for i in range(60)])
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(retrieve.top_k(df, df, 3)) == key(retrieve.top_k(df, df.repartition(7), 3, block_bytes=512))


def test_many_equal_vectors_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "ROWS", 7)
    monkeypatch.setattr(retrieve, "QUERIES", 2)
    rng = np.random.default_rng(8)
    x = np.concatenate([np.tile(rng.normal(size=4), (40, 1)), rng.integers(-1, 2, (40, 4))]).astype(float)
    df = vectors(spark, [(f"{i:03}", "a", x[i].tolist()) for i in range(80)])
    unit = [v / np.linalg.norm(v) if v.any() else None for v in x]
    want = []
    for i, q in enumerate(unit):
        if q is not None:
            near = sorted(((round(float(q @ g), 12) + 0.0, f"{j:03}") for j, g in enumerate(unit) if g is not None), reverse=True)[:3]
            want += [(f"{i:03}", g, r + 1) for r, (_, g) in enumerate(near)]
    got = retrieve.top_k(df.repartition(2), df.repartition(3), 3).collect()
    assert sorted((r["query_id"], r["gallery_id"], r["rank"]) for r in got) == sorted(want)


def test_open_set_threshold_is_inclusive(spark):
    rows = [("at", "a", [(0.4, "a")]), ("under", "a", [(0.3999999, "a")]), ("over", "a", [(0.41, "a")])]
    p = spark.createDataFrame(rows, "image_id string, predicted_class string, top_n array<struct<similarity:double,class:string>>")
    got = {r["image_id"]: r["decision"] for r in retrieve.open_set(p).collect()}
    assert got == {"at": "a", "under": "Unknown class.", "over": "a"}


def test_missing_label_raises(spark):
    g = spark.createDataFrame([("a",), ("b",)], "image_id string")
    labels = spark.createDataFrame([("a", "x")], "image_id string, identity string")
    with pytest.raises(KeyError):
        retrieve.with_labels(g, labels)
    assert retrieve.with_labels(g, labels, require=False).count() == 1


def judged(spark, pairs):
    rows = [(str(i), t, p, [(1.0, p)]) for i, (t, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "image_id string, true_class string, predicted_class string, top_n array<struct<similarity:double,class:string>>")


def test_report_edges(spark):
    j = judged(spark, [("a", "a"), ("a", "c"), ("b", "a")])
    rep = {r["class"]: r.asDict() for r in evaluate.per_class_report(j).collect()}
    assert rep["c"] == {"class": "c", "precision": 0.0, "recall": 0.0, "f1": 0.0, "support": 0}
    assert rep["b"]["recall"] == 0.0 and rep["a"]["precision"] == 0.5
    avg = {r["average"]: r for r in evaluate.report_averages(evaluate.per_class_report(j)).collect()}
    assert avg["weighted avg"]["recall"] == pytest.approx(evaluate.accuracy(j).first()["accuracy"])
    pairs = [(r["true_class"], r["predicted_class"], r["count"]) for r in evaluate.most_confused(j, 5).collect()]
    assert pairs == [("b", "a", 1), ("a", "b", 0)]  # zero pairs stay; c is no true class


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abcd")), min_size=1, max_size=20))
def test_weighted_recall_is_accuracy(spark, pairs):
    j = judged(spark, pairs)
    avg = {r["average"]: r for r in evaluate.report_averages(evaluate.per_class_report(j)).collect()}
    assert avg["weighted avg"]["recall"] == pytest.approx(evaluate.accuracy(j).first()["accuracy"])


def test_pipeline_on_separable_bags(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows, items = [], []
    for c in range(3):
        direction = rng.normal(size=8) * 4
        for b in range(6):
            items.append((f"{c}_{b}", f"class{c}"))
            rows += [(f"{c}_{b}", i, [float(v) for v in direction + rng.normal(size=8) * 0.3]) for i in range(10)]
    catalog = spark.createDataFrame([*items, ("empty", "class0")], "image_id string, identity string")
    descriptors = spark.createDataFrame(rows, "image_id string, desc_idx int, desc array<double>")
    settings_ = pipeline.Settings(n_components=4, n_mixtures=2, gmm_iterations=10)
    done = pipeline.train(catalog, descriptors, settings_)
    assert done.summary.first()["accuracy"] == 1.0
    assert [r["image_id"] for r in done.skipped.collect()] == ["empty"]
    root = f"file://{tmp_path}/index"
    pipeline.build_index(spark, catalog, descriptors, root, settings_)
    got = {r["image_id"]: r["decision"] for r in pipeline.predict(spark, root, descriptors).collect()}
    assert got == dict(items)


def test_fitting_on_the_driver_and_by_jobs_agree(spark, monkeypatch):
    x = np.concatenate([RNG.normal(-2, 1, (90, 3)), RNG.normal(2, 0.5, (60, 3))])
    df = table(spark, x).repartition(5)
    near = gmm.fit(df, 2, vec="v", max_iter=5, tol=-1.0)
    monkeypatch.setattr(gmm, "LOCAL_BYTES", 0)
    far = gmm.fit(df, 2, vec="v", max_iter=5, tol=-1.0)
    assert all(np.allclose(getattr(near, f), getattr(far, f)) for f in ("weights", "means", "variances"))


def test_mixtures_start_from_distinct_vectors(spark):
    x = np.concatenate([np.zeros((300, 2)), np.arange(20.0).reshape(10, 2)])
    once, again = (gmm.initial(table(spark, x).repartition(n), 3, vec="v") for n in (1, 7))
    assert np.allclose(once.means, again.means) and len(np.unique(once.means, axis=0)) == 3
    with pytest.raises(ValueError):
        gmm.initial(table(spark, np.zeros((9, 2))), 2, vec="v")


def test_train_reads_stored_sides_and_takes_a_given_split(spark, monkeypatch):
    rng = np.random.default_rng(6)
    items = [(f"{c}_{b}", f"c{c}", "train" if b < 4 else "test") for c in range(3) for b in range(6)]
    away = rng.normal(size=(3, 6)) * 4
    rows = [(i, d, (away[int(i[0])] + rng.normal(size=6) * 0.2).tolist()) for i, _, _ in items for d in range(8)]
    catalog = spark.createDataFrame(items, "image_id string, identity string, split string")
    descriptors = spark.createDataFrame(rows, "image_id string, desc_idx int, desc array<double>")
    done = pipeline.train(catalog, descriptors, pipeline.Settings(n_components=4))
    row = done.summary.first()
    assert row["accuracy"] == 1.0 and row["n"] == 6
    assert sorted(r["image_id"] for r in done.predictions.collect()) == sorted(i for i, _, s in items if s == "test")
    text = done.predictions._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in text and "Join" not in text
