"""Ranks, quantiles, correlations and splits against direct computation."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskgrove.operators import evaluate, ranks, split, stats

SLOW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
NUMBERS = st.lists(
    st.one_of(
        st.integers(-5, 5).map(float),
        st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: v + 0.0),
    ),
    min_size=2,
    max_size=60,
)


@SLOW
@given(NUMBERS)
def test_average_ranks(spark, numbers):
    rows = spark.createDataFrame([(v,) for v in numbers], "v double")
    got = {r["v"]: r["avg_rank"] for r in ranks.average_ranks(rows, "v").collect()}
    want = pd.Series(numbers).rank()
    for v, rank in zip(numbers, want):
        assert got[v] == rank
    assert sum(got[v] for v in numbers) / len(numbers) == pytest.approx((len(numbers) + 1) / 2)


@SLOW
@given(NUMBERS)
def test_quantiles(spark, numbers):
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    rows = spark.createDataFrame([(v,) for v in numbers], "v double")
    got = {r["p"]: r["q"] for r in ranks.exact_quantiles(rows, ["v"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(numbers, p)), rel=1e-9, abs=1e-9)


def test_cells_never_decrease(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1.0, 1.0000001, -7.5, 1e18, -1e18, 1e300, float("inf"), -float("inf")])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = [r["c"] for r in rows.select("i", ranks.value_cell(F.col("v")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells)


def test_crowded_values_spread_over_cells(spark):
    """Values far from zero with a small spread: one rough cell, cut by its own range."""
    rng = np.random.default_rng(2)
    numbers = 1e9 + rng.uniform(-500, 500, 3000)
    numbers = np.concatenate([numbers, numbers[:50], [-1e9, 0.0, 5.0]])
    rows = spark.createDataFrame([(float(v),) for v in numbers], "v double")
    counts = rows.groupBy("v").agg(F.count("*").alias("ties"))
    placed = ranks.in_cells(counts, [], "v", cell_values=100)
    assert counts.select(ranks.value_cell(F.col("v"))).distinct().count() <= 5
    sizes = [r["count"] for r in placed.groupBy("__cell").count().collect()]
    assert len(sizes) > 25 and max(sizes) < 300
    cells = [r["__cell"] for r in placed.orderBy("v").collect()]
    assert cells == sorted(cells)


def test_ranks_and_quantiles_of_crowded_values(spark, monkeypatch):
    monkeypatch.setattr(ranks.in_cells, "__defaults__", (ranks.FINENESS, 100))
    rng = np.random.default_rng(4)
    numbers = np.round(1e9 + rng.uniform(-500, 500, 2000), 1)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 2000), "v": numbers})
    rows = spark.createDataFrame(frame)
    got = {r["v"]: r["avg_rank"] for r in ranks.average_ranks(rows, "v").collect()}
    assert [got[v] for v in frame.v] == frame.v.rank().tolist()
    found = ranks.exact_quantiles(rows, ["v"], [0.0, 0.3, 0.5, 1.0], ["g"]).collect()
    assert len(found) == 8
    for r in found:
        assert r["q"] == pytest.approx(float(np.quantile(frame.v[frame.g == r["g"]], r["p"])), rel=1e-14)


def test_quantiles_when_one_group_and_one_value_dominate(spark):
    """A third of all rows in one group, most of them one value; extreme outliers."""
    data = [("hot", 7.0)] * 400 + [("hot", float(i)) for i in range(200)]
    data += [("g%d" % (i % 20), i * 1.5) for i in range(1200)] + [("hot", 1e15), ("g1", -1e15)]
    rows = spark.createDataFrame(data, "g string, v double")
    got = {(r["g"], r["p"]): r["q"] for r in ranks.exact_quantiles(rows, ["v"], [0.25, 0.5, 0.99], ["g"]).collect()}
    frame = pd.DataFrame(data, columns=["g", "v"])
    for (g, p), q in got.items():
        assert q == pytest.approx(float(np.quantile(frame.v[frame.g == g], p)), rel=1e-12)
    assert len(got) == 21 * 3


def test_no_unkeyed_window_over_rows(spark):
    """Every window over rows is partitioned by cell; group windows see cells only."""
    rows = spark.range(1000).select((F.col("id") % 10).alias("g"), F.col("id").cast("double").alias("v"))
    plan = ranks.average_ranks(rows, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line or "WindowGroupLimit" in line]
    assert windows and any("__cell" in line for line in windows)


def test_spearman_matches_ranked_pearson(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": rng.integers(0, 9, 300), "b": rng.normal(size=300), "c": rng.integers(0, 3, 300)})
    got = stats.spearman_matrix(spark.createDataFrame(frame), ["a", "b", "c"]).collect()
    want = frame.rank().corr()
    assert len(got) == 9
    for r in got:
        assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-12)


def test_spearman_with_more_values_than_a_broadcast_takes(spark, monkeypatch):
    monkeypatch.setattr(stats, "SMALL_ROWS", 10)
    frame = pd.DataFrame({"a": np.arange(100) % 37, "b": (np.arange(100) * 31) % 97})
    got = {(r["a"], r["b"]): r["r"] for r in stats.spearman_matrix(spark.createDataFrame(frame), ["a", "b"]).collect()}
    assert got[("a", "b")] == pytest.approx(frame.rank().corr().loc["a", "b"], abs=1e-12)


def test_joins_beyond_the_broadcast_limit_stay_whole(spark):
    big = spark.range(50).select((F.col("id") % 25).alias("k"))
    small = spark.range(25).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for limit in (5, 100):
        assert ranks.attach_small(big, small, ["k"], max_rows=limit).count() == 50


def test_correlation_of_constant_column_is_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 9.0)], "a double, b double")
    got = {(r["a"], r["b"]): r["r"] for r in stats.pearson_matrix(rows, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and got[("a", "a")] is None and got[("b", "b")] == pytest.approx(1.0)


def test_mann_whitney_and_kruskal_agree_for_two_groups(spark):
    data = [("x", float(v)) for v in [1, 2, 2, 5, 8, 9, 9]] + [("y", float(v)) for v in [2, 3, 3, 7, 9, 12]]
    rows = spark.createDataFrame(data, "g string, v double")
    h = stats.kruskal(rows, "v", ["g"]).first()["h"]
    u = stats.mann_whitney(rows, "v", "g", "x", "y").first()
    frame = pd.DataFrame(data, columns=["g", "v"])
    rank = frame.v.rank()
    n1, n2 = 7, 6
    assert u["u"] == pytest.approx(rank[frame.g == "x"].sum() - n1 * (n1 + 1) / 2)
    n = n1 + n2
    ties = sum(t**3 - t for t in frame.v.value_counts())
    variance = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    assert h == pytest.approx((u["u"] - n1 * n2 / 2) ** 2 / variance, rel=1e-9)
    assert 0 <= u["p"] <= 1


def test_kruskal_of_a_single_group(spark):
    rows = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 3.0)], "g string, v double")
    r = stats.kruskal(rows, "v", ["g"]).first()
    assert r["groups"] == 1 and r["h"] == pytest.approx(0.0, abs=1e-9)


def test_split_is_exact_and_repeatable(spark):
    rows = spark.range(1000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 < 9, 1).otherwise(2).alias("label")
    )
    first = split.stratified_split(rows, "label", "k").orderBy("k").collect()
    again = split.stratified_split(rows.repartition(5), "label", "k").orderBy("k").collect()
    assert first == again
    sizes = pd.Series([(r["label"], r["split"]) for r in first]).value_counts()
    assert (sizes[(0, "test")], sizes[(1, "test")], sizes[(2, "test")]) == (140, 40, 20)
    other = split.stratified_split(rows, "label", "k", seed=7).orderBy("k").collect()
    assert first != other


def test_folds_are_even_per_class(spark):
    rows = spark.range(1003).select(F.col("id").alias("k"), (F.col("id") % 3).alias("label"))
    got = split.stratified_folds(rows, "label", "k", 5).groupBy("label", "fold").count().collect()
    for label in range(3):
        sizes = [r["count"] for r in got if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_metrics_when_a_class_is_never_predicted(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "label int, prediction int")
    r = evaluate.metrics(rows).first()
    assert r["accuracy"] == 0.75
    assert r["macro_precision"] == pytest.approx((2 / 3 + 0 + 1) / 3)
    cells = evaluate.confusion(rows, [0, 1, 2]).collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == 4


def test_auc_of_perfect_and_constant_scores(spark):
    rows = spark.createDataFrame([(0, 0.1, 0.5), (0, 0.2, 0.5), (1, 0.8, 0.5)], "label int, a double, b double")
    assert evaluate.auc(rows, {1: "a"}).first()["auc"] == 1.0
    assert evaluate.auc(rows, {1: "b"}).first()["auc"] == 0.5


def test_roc_is_monotone_and_ends_at_one(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"label": rng.integers(0, 2, 200), "s": rng.integers(0, 20, 200) / 20})
    points = evaluate.roc(spark.createDataFrame(frame), {1: "s"}).orderBy(F.desc("threshold")).collect()
    for side in ("fpr", "tpr"):
        line = [p[side] for p in points]
        assert line == sorted(line) and line[-1] == 1.0


def test_split_of_odd_classes(spark):
    rows = [(i, "a") for i in range(7)] + [(100, "b")] + [(i, None) for i in range(200, 210)]
    frame = spark.createDataFrame(rows, "k long, label string")
    got = split.stratified_split(frame, "label", "k").groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in got} == {
        ("a", "test"): 1, ("a", "train"): 6, ("b", "train"): 1, (None, "test"): 2, (None, "train"): 8,
    }
    assert split.stratified_split(frame, "label", "k", 1.0).where("split = 'train'").count() == 0
    assert split.stratified_split(frame, "label", "k", 0.0).where("split = 'test'").count() == 0
    assert split.stratified_split(frame.limit(0), "label", "k").count() == 0
