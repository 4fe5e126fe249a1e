"""Invariants of fitted models."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskgrove.operators import attribution, centres, cluster, models, split, trees, treeshap, tuning

CLASSES = [0, 1, 2]
FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame(rng.normal(size=(400, 4)), columns=FEATURES)
    frame["label"] = np.where(frame.a + frame.b * frame.c > 0.5, 2, np.where(frame.d > 0, 1, 0)).astype("int32")
    frame["k"] = np.arange(len(frame))
    return spark.createDataFrame(frame).persist()


@pytest.fixture(scope="module")
def boosted(rows):
    profile = models.BoostProfile(rounds=4, depth=4, leaves=6, step=0.3, min_child=5, l1=0.0)
    return models.fit_boosted(rows, FEATURES, CLASSES, profile, key="k")


@pytest.fixture(scope="module")
def forest(rows):
    return models.fit_forest(rows, FEATURES, models.ForestProfile(trees=3, depth=3), key="k")


def same_trees(one, two):
    for a, b in zip([t for own in one.trees for t in own], [t for own in two.trees for t in own], strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
        assert np.allclose(a.value, b.value, atol=1e-6) and np.allclose(a.cover, b.cover)


def test_summed_histograms_grow_the_trees_of_one_task(rows):
    """Large nodes are split from sums over blocks, small ones in a task; the trees are the same."""
    profile = models.BoostProfile(rounds=3, depth=5, leaves=9, step=0.3, min_child=3, patience=50)
    fit = lambda n: models.fit_boosted(rows.repartition(4), FEATURES, CLASSES, profile, key="k", local_rows=n)
    same_trees(fit(10_000), fit(60))
    grown = lambda n: models.fit_forest(
        rows.repartition(3), FEATURES, models.ForestProfile(trees=4, depth=6), key="k", local_rows=n
    )
    same_trees(grown(10_000), grown(90))


def plain_split(x, g, h, min_child, l2):
    """The best (gain, feature, bin) of all rows by direct sums."""
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    whole, best = score(np.ones(len(x), bool)), (0.0, None, None)
    for f in range(x.shape[1]):
        for b in range(int(x[:, f].max())):
            left = x[:, f] <= b
            if left.sum() >= min_child and (~left).sum() >= min_child:
                gain = score(left) + score(~left) - whole
                if gain > best[0] + 1e-9:
                    best = (gain, f, b)
    return best


def test_splits_equal_direct_sums():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (300, 3)).astype(np.uint8)
    g, h = rng.normal(size=300) + (x[:, 1] > 4), rng.uniform(0.1, 0.3, 300)
    rule = trees.Rule(True, 16, 3, 10, 20, 0.0, 0.0, 0.5)
    grown = trees.grow_here(x, np.stack([g, h, np.ones(300)], axis=1), rule, trees.Columns(3), 1)
    tree = trees.flat_tree(*grown, rule)
    assert (tree.gain[0], tree.feature[0], tree.cut[0]) == pytest.approx(plain_split(x, g, h, 10, 0.5))
    leaf = tree.leaf_of(x)
    for at in np.unique(leaf):
        m = leaf == at
        assert tree.cover[at] == m.sum() and tree.value[at, 0] == pytest.approx(-g[m].sum() / (h[m].sum() + 0.5))


def test_leaf_limit_takes_the_best_splits_first():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 30, (2000, 4)).astype(np.uint8)
    g = rng.normal(size=2000) + np.sin(x[:, 0]) + (x[:, 1] > 11) * (x[:, 2] > 20)
    c = np.stack([g, np.ones(2000), np.ones(2000)], axis=1)
    grow = lambda leaves: trees.grow_here(x, c, trees.Rule(True, 32, 7, 5, 10, leaves=leaves), trees.Columns(4), 1)
    ids, features, cuts, gains, totals = grow(0)
    at = dict(zip(ids.tolist(), zip(features, gains)))
    # The usual queue over the whole tree, ten leaves.
    taken, queue = set(), [1]
    for _ in range(9):
        best = max((i for i in queue if at[i][0] >= 0), key=lambda i: at[i][1])
        taken.add(best)
        queue = [i for i in queue if i != best] + [2 * best, 2 * best + 1]
    limited = trees.flat_tree(*grow(10), trees.Rule(True, 32, 7, 5, 10, leaves=10))
    assert (limited.feature >= 0).sum() == 9
    assert sorted(limited.gain[limited.feature >= 0]) == pytest.approx(sorted(at[i][1] for i in taken))


def test_patience_ends_the_fit_early(rows):
    profile = models.BoostProfile(rounds=200, depth=4, step=0.5, min_child=2, patience=4)
    model = models.fit_boosted(rows, FEATURES, CLASSES, profile, key="k")
    kept = len(model.trees[0])
    assert kept < len(model.losses) < 200 and len(model.losses) - kept >= 4
    assert model.losses[kept - 1] == min(model.losses)


def test_a_shorter_fit_is_a_prefix(rows):
    fit = lambda n: models.fit_boosted(rows, FEATURES, CLASSES, models.BoostProfile(rounds=n, depth=2, step=0.1))
    short, long = fit(2), fit(4)
    long.trees = [own[:2] for own in long.trees]
    same_trees(short, long)


def test_fits_that_share_passes_equal_fits_alone(rows):
    folded = split.stratified_folds(rows, "label", "k", 2)
    profiles = [models.BoostProfile(rounds=3, depth=d, step=0.3, min_child=5) for d in (2, 4)]
    both = models.fit_folds(folded, FEATURES, CLASSES, profiles, 2, "k")
    alone = models.fit_folds(folded, FEATURES, CLASSES, profiles[1:], 2, "k")
    for one, two in zip(both[1], alone[0]):
        same_trees(one, two)
        assert one.losses == pytest.approx(two.losses)


def test_long_paths_equal_tabled_ones(rows, boosted, monkeypatch):
    x = trees.binned(rows.limit(50).select(*FEATURES).toPandas().to_numpy(), boosted.edges)
    one = treeshap.shapley(treeshap.ensemble_leaves(boosted), x, 3)
    monkeypatch.setattr(treeshap, "TABLED", 1)
    assert np.allclose(one, treeshap.shapley(treeshap.ensemble_leaves(boosted), x, 3))


def test_sums_equal_the_long_table(rows, boosted):
    long, _ = treeshap.tree_shap(boosted, rows, FEATURES, CLASSES, "k")
    sums = treeshap.mean_sizes(boosted, rows, "k")
    read = lambda table: table.orderBy("feature").toPandas().set_index("feature")
    pd.testing.assert_frame_equal(
        read(attribution.importance_of_sums(sums)), read(attribution.global_importance(long))
    )
    named = long.withColumnRenamed("k", "row_id")
    scored = models.score(boosted, rows, CLASSES).withColumnRenamed("k", "row_id")
    pd.testing.assert_frame_equal(
        read(attribution.comparison_of_sums(sums)), read(attribution.high_low_comparison(named, scored))
    )


def test_probabilities_sum_to_one(rows, boosted, forest):
    for model in (boosted, forest):
        got = models.score(model, rows, CLASSES).toPandas()
        assert np.allclose(got[["p0", "p1", "p2"]].sum(axis=1), 1)
        assert (got["prediction"] == got[["p0", "p1", "p2"]].to_numpy().argmax(axis=1)).all()
        assert (got["prediction"] == got["label"]).mean() > 0.5


def test_contributions_add_up_to_the_output(rows, boosted, forest):
    for model in (boosted, forest):
        long, base = treeshap.tree_shap(model, rows, FEATURES, CLASSES, "k")
        got = long.groupBy("k", "class").agg(F.sum("shap").alias("s")).toPandas()
        own = models.margins(model, rows, CLASSES).toPandas().set_index("k")
        explained = got.s + got["class"].map(dict(enumerate(base)))
        want = [own.loc[k, f"m{c}"] for k, c in zip(got.k, got["class"])]
        assert np.allclose(explained, want, atol=1e-9)


def test_contributions_equal_brute_force(spark, rows, forest):
    """Shapley values by all subsets, with the path-dependent expectation of each tree."""
    nodes = [r.asDict() for r in models.tree_nodes(forest, CLASSES, spark).collect()]
    grown = {}
    for n in nodes:
        grown.setdefault(n["tree"], {})[n["id"]] = n

    def expect(tree, at, x, known):
        node = tree[at]
        if node["feature"] is None:
            return np.array(node["value"])
        left, right = tree[node["left"]], tree[node["right"]]
        if node["feature"] in known:
            side = node["left"] if x[node["feature"]] <= node["threshold"] else node["right"]
            return expect(tree, side, x, known)
        return (
            expect(tree, node["left"], x, known) * left["cover"]
            + expect(tree, node["right"], x, known) * right["cover"]
        ) / node["cover"]

    def value(x, known):
        return sum(expect(t, 0, x, known) for t in grown.values()) / len(grown)

    long, _ = treeshap.tree_shap(forest, rows.limit(6), FEATURES, CLASSES, "k")
    got = long.toPandas()
    for k, part in got.groupby("k"):
        x = part[part["class"] == 0].set_index("feature").loc[FEATURES, "value"].to_numpy()
        for j, name in enumerate(FEATURES):
            others = [i for i in range(4) if i != j]
            total = np.zeros(3)
            for size in range(4):
                weight = factorial(size) * factorial(3 - size) / factorial(4)
                for known in combinations(others, size):
                    total += weight * (value(x, {*known, j}) - value(x, set(known)))
            mine = part[part.feature == name].sort_values("class").shap.to_numpy()
            assert np.allclose(mine, total, atol=1e-9)


def test_importances_count_every_split(spark, boosted):
    nodes = models.tree_nodes(boosted, CLASSES, spark)
    table = models.importances(nodes, [*FEATURES, "unused"]).toPandas().set_index("feature")
    inner = nodes.where(F.col("feature").isNotNull()).count()
    assert table.importance_split.sum() == inner
    assert table.loc["unused", "importance_split"] == 0
    covers = {(r["class"], r["tree"], r["id"]): r for r in nodes.collect()}
    for (k, t, _), r in covers.items():
        if r["feature"] is not None:
            assert r["cover"] == covers[(k, t, r["left"])]["cover"] + covers[(k, t, r["right"])]["cover"]


def test_saved_ensembles_score_the_same(spark, rows, boosted, forest, tmp_path):
    for name, model in (("b", boosted), ("f", forest)):
        models.save_ensemble(model, spark, str(tmp_path / name))
        again = models.load_ensemble(spark, str(tmp_path / name))
        same_trees(model, again)
        one = models.score(model, rows, CLASSES).orderBy("k").toPandas()
        pd.testing.assert_frame_equal(one, models.score(again, rows, CLASSES).orderBy("k").toPandas())


def test_boosted_grid_table(rows):
    folded = split.stratified_folds(rows, "label", "k", 3)
    base = models.BoostProfile(rounds=3, step=0.3, min_child=5)
    table, best = tuning.boosted_grid(folded, FEATURES, CLASSES, base, {"depth": [1, 3]}, 3, "k")
    got = table.toPandas()
    assert len(got) == 2 and got.loc[got.mean_test_score.idxmax(), "param_depth"] == best["depth"]
    assert (got.mean_test_score > 0.3).all() and (got.mean_fit_time > 0).all()
    truth, guess = np.array([0, 0, 1, 2, 2]), np.array([0, 1, 1, 2, 0])
    table = np.bincount(truth * 3 + guess, minlength=9).reshape(3, 3)
    assert tuning.macro_f1(table) == pytest.approx((0.5 + 2 / 3 + 2 / 3) / 3)


def test_grid_search_table(rows):
    folded = split.stratified_folds(rows, "label", "k", 3).persist()
    fit = lambda train, point: models.fit_forest(train, FEATURES, models.ForestProfile(trees=2, **point))
    table, best = tuning.grid_search(folded, fit, {"depth": [1, 3]}, 3, CLASSES, parallelism=2)
    got = table.toPandas()
    assert len(got) == 2 and set(got.rank_test_score) <= {1, 2} and 1 in set(got.rank_test_score)
    for _, r in got.iterrows():
        scores = [r[f"split{i}_test_score"] for i in range(3)]
        assert r.mean_test_score == pytest.approx(np.mean(scores))
        assert r.std_test_score == pytest.approx(np.std(scores))
    assert best["depth"] == got.loc[got.mean_test_score.idxmax(), "param_depth"]


def test_registered_ensembles_fit(spark):
    """The registered queries run at their published sizes, and the fits end early by patience."""
    from riskgrove.catalog import models as registered

    sf_dir = "/root/testdata/sf0.001"
    for query in (registered.boosted_scores, registered.forest_scores):
        got = query(spark, sf_dir).toPandas()
        assert len(got) > 1000 and np.allclose(got[["p0", "p1", "p2"]].sum(axis=1), 1)
    model = registered.boosted(spark, sf_dir)
    assert len(model.trees[0]) < len(model.losses) < models.FIRST_BOOST.rounds
    assert len(registered.forest(spark, sf_dir).trees[0]) == 300


def test_grid_points():
    assert len(tuning.grid_points({"a": [1, 2], "b": [1, 2], "c": [1, 2], "d": [1, 2]})) == 16


def test_kmeans_inertia_falls_and_criteria_differ_by_rule(rows):
    vectors = cluster.scaled_vectors(rows, FEATURES, ["k"]).persist()
    sweep = cluster.kmeans_sweep(vectors, [2, 3, 4], seeds=[1, 2], max_iter=10).toPandas()
    assert list(sweep.inertia) == sorted(sweep.inertia, reverse=True)
    mix = cluster.gmm_sweep(vectors, [2], max_iter=5).first()
    free = 2 * 4 + 2 * 10 + 1
    assert mix["bic"] - mix["aic"] == pytest.approx(free * (np.log(400) - 2))


def plain_lloyd(x, start, tol):
    at = start.copy()
    while True:
        own = ((x[:, None] - at[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[own == c].mean(0) if (own == c).any() else at[c] for c in range(len(at))])
        if ((new - at) ** 2).sum() <= tol:
            return at, own
        at = new


def test_kmeans_equals_plain_rounds(rows):
    vectors = cluster.scaled_vectors(rows, FEATURES, ["k"]).persist()
    x = np.stack([r.features.toArray() for r in vectors.orderBy("k").collect()])
    sweep = cluster.fit_kmeans_sweep(vectors, [2, 5], seeds=[1, 2, 3])
    sample = cluster.start_sample(vectors)
    assert len(sample) == 400
    for k, model in sweep.models.items():
        fits = [plain_lloyd(x, centres.spread_starts(sample, k, s), 1e-4 * x.var(axis=0).mean()) for s in (1, 2, 3)]
        inertias = [((x - at[own]) ** 2).sum() for at, own in fits]
        assert model.inertia == pytest.approx(min(inertias))
        at, own = fits[int(np.argmin(inertias))]
        got = vectors.select("k", centres.nearest(model.centres, F.col("features")).alias("c")).orderBy("k").toPandas()
        assert got.c.tolist() == own.tolist()
        gap = ((x[:, None] - x[None]) ** 2).sum(-1)
        s = []
        for i in range(len(x)):
            a = gap[i, own == own[i]].sum() / max((own == own[i]).sum() - 1, 1)
            b = min(gap[i, own == c].mean() for c in range(k) if c != own[i])
            s.append((b - a) / max(a, b))
        record = next(r for r in sweep.records if r[0] == k)
        assert record[2] == pytest.approx(np.mean(s), rel=1e-9)
        between = sum((own == c).sum() * ((x[own == c].mean(0) - x.mean(0)) ** 2).sum() for c in range(k))
        within = sum(((x[own == c] - x[own == c].mean(0)) ** 2).sum() for c in range(k))
        assert record[3] == pytest.approx(between / (k - 1) / (within / (400 - k)), rel=0.02)


def test_mixtures_keep_their_floor_with_constant_and_collinear_columns(spark):
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.normal(-4, 1, 300), rng.normal(4, 1, 300)])
    frame = pd.DataFrame({"a": a, "b": 2 * a, "c": 1.0, "d": (a > 0).astype(float), "k": np.arange(600)})
    vectors = cluster.scaled_vectors(spark.createDataFrame(frame), ["a", "b", "c", "d"], ["k"]).persist()
    found = cluster.fit_gmm_sweep(vectors, [2, 3, 4])
    for m in found.values():
        assert np.isfinite(m.log_likelihood) and all(b >= a - 1e-6 for a, b in zip(m.path, m.path[1:]))
        assert m.weights.sum() == pytest.approx(1)
    got = vectors.select("k", centres.likeliest(found[2], F.col("features")).alias("c")).toPandas().sort_values("k")
    assert got.c.nunique() == 2 and (got.c.to_numpy() == got.c.to_numpy()[0]).tolist() == (a < 0).tolist()


def test_pca_scores_are_centred_and_uncorrelated(rows):
    scores, parts = cluster.pca(cluster.scaled_vectors(rows, FEATURES, ["k"]))
    frame = scores.toPandas()
    assert abs(frame.pc1.mean()) < 1e-9 and abs(frame.pc1.corr(frame.pc2)) < 1e-9
    assert 0 < sum(parts) <= 1


def test_sampled_silhouette_against_direct_computation(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(80, 2)), columns=["x", "y"])
    frame["g"] = (frame.x > 0).astype(int)
    frame["k"] = np.arange(80)
    got = cluster.sampled_silhouette(spark.createDataFrame(frame), ["x", "y"], "g", "k").first()[0]
    p = frame[["x", "y"]].to_numpy()
    gap = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    own = []
    for i in range(80):
        same = (frame.g == frame.g[i]).to_numpy()
        a = gap[i, same].sum() / (same.sum() - 1)
        b = gap[i, ~same].mean()
        own.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(own), rel=1e-12)


def test_waterfall_rest_and_fallback(spark):
    shap = spark.createDataFrame(
        [(i, c, f, 1.0, v * (c + 1)) for i in range(2) for c in CLASSES for f, v in [("a", 0.1), ("b", -0.5), ("c", 0.3)]],
        "row_id int, class int, feature string, value double, shap double",
    )
    predictions = spark.createDataFrame([(0, 1), (1, 1)], "row_id int, prediction int")
    got = attribution.waterfall(shap, predictions, 2, F.lit(0.0), fallback=1, n=2).orderBy("rank").collect()
    assert [(r["row_id"], r["feature"]) for r in got] == [(1, "b"), (1, "c"), (1, "rest")]
    assert got[2]["shap"] == pytest.approx(0.3)
