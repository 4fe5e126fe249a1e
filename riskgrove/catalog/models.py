"""Queries on ensembles fitted to the given tables.

Fitted ensembles and the prepared table are kept per session and input folder, as several
queries look at the same model.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from riskgrove.catalog.profiles import split_sql
from riskgrove.catalog.registry import RISK_CODE_SQL, over_jobs, register, rounded
from riskgrove.operators import (
    attribution as H,
    evaluate as M,
    models as L,
    select as Q,
    split as V,
    treeshap,
    tuning as T,
)
from riskgrove.operators.encode import scaler_numbers
from riskgrove.plans.prepare import Prepared, prepare
from riskgrove.session import free_shuffles, shared_path
from riskgrove.sources import files as IO, schema as S
from riskgrove.sources.tables import jobs

CLASSES = S.RISK_CODES
SCORES = {0: "p0", 1: "p1", 2: "p2"}
_KEPT: dict[tuple, object] = {}

#: The published grid.
GRID = {"depth": [6, 8], "leaves": [31, 63], "min_child": [20, 50], "step": [0.05, 0.1]}


def _once(spark, sf_dir, what, make):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def prepared(spark, sf_dir) -> Prepared:
    """The prepared table, written once to the shared folder: fits pass over it many times."""

    def make():
        ready = prepare(jobs(spark, sf_dir, heavy=True))
        path = shared_path(spark, "matrix")
        IO.write_table(ready.rows, path)
        features = ready.features
        del ready
        free_shuffles(spark)
        return Prepared(spark.read.parquet(path), features)

    return _once(spark, sf_dir, "prepared", make)


def matrix_scaler(spark, sf_dir) -> list[tuple]:
    """Mean and std of the matrix's columns over all rows."""
    ready = prepared(spark, sf_dir)
    return _once(spark, sf_dir, "scaler", lambda: scaler_numbers(ready.rows, ready.features))


def boosted(spark, sf_dir):
    ready = prepared(spark, sf_dir)
    fit = lambda: L.fit_boosted(ready.train, ready.features, CLASSES, L.FIRST_BOOST, key="row_id")
    return _once(spark, sf_dir, "boosted", fit)


def second_boosted(spark, sf_dir):
    ready = prepared(spark, sf_dir)
    fit = lambda: L.fit_boosted(ready.train, ready.features, CLASSES, L.SECOND_BOOST, key="row_id")
    return _once(spark, sf_dir, "second boosted", fit)


def forest(spark, sf_dir):
    ready = prepared(spark, sf_dir)
    return _once(spark, sf_dir, "forest", lambda: L.fit_forest(ready.train, ready.features, L.FOREST, classes=CLASSES, key="row_id"))


def _folded(spark, sf_dir, k):
    """The training rows with folds, written once: every trial filters the same folds."""

    def make():
        path = shared_path(spark, "folds")
        train = prepared(spark, sf_dir).train
        IO.write_table(V.stratified_folds(train, "label", "row_id", k), path)
        return spark.read.parquet(path)

    return _once(spark, sf_dir, f"folds {k}", make)


def searched(spark, sf_dir):
    """The table of the grid and its best point."""

    def make():
        features = prepared(spark, sf_dir).features
        base = replace(L.TUNED_BOOST, rounds=L.GRID_ROUNDS)
        return T.boosted_grid(_folded(spark, sf_dir, 3), features, CLASSES, base, GRID, 3, "row_id")

    return _once(spark, sf_dir, "grid", make)


def _best_profile(spark, sf_dir) -> L.BoostProfile:
    return L.BoostProfile(**{**L.TUNED_BOOST.__dict__, **searched(spark, sf_dir)[1]})


def tuned(spark, sf_dir):
    """The boosted ensemble of the best grid point, fitted to all training rows."""

    def make():
        ready = prepared(spark, sf_dir)
        profile = _best_profile(spark, sf_dir)
        return L.fit_boosted(ready.train, ready.features, CLASSES, profile, key="row_id")

    return _once(spark, sf_dir, "tuned", make)


_OUT = ["row_id", "label", "p0", "p1", "p2", "prediction"]


@register("l01_boosted_scores")
def boosted_scores(spark, sf_dir):
    return L.score(boosted(spark, sf_dir), prepared(spark, sf_dir).test, CLASSES).select(*_OUT)


@register("l02_second_boosted_scores")
def second_boosted_scores(spark, sf_dir):
    return L.score(second_boosted(spark, sf_dir), prepared(spark, sf_dir).test, CLASSES).select(*_OUT)


@register("l03_forest_scores")
def forest_scores(spark, sf_dir):
    return L.score(forest(spark, sf_dir), prepared(spark, sf_dir).test, CLASSES).select(*_OUT)


@register("l04_scores_full")
def scores_full(spark, sf_dir):
    rows = prepared(spark, sf_dir).rows
    return L.score(tuned(spark, sf_dir), rows, CLASSES).select("split", *_OUT)


@register(
    "l04_scores_check",
    over_jobs(
        split_sql(RISK_CODE_SQL)
        + "SELECT split, count(*) AS n, CAST(0 AS BIGINT) AS broken FROM split_rows GROUP BY split"
    ),
)
def scores_check(spark, sf_dir):
    """Rows of each split, and those whose probabilities don't sum to 1, don't name the predicted
    class, or differ after the ensemble was saved and loaded."""
    model, rows, path = tuned(spark, sf_dir), prepared(spark, sf_dir).rows, shared_path(spark, "ensemble")
    L.save_ensemble(model, spark, path)
    again = L.score(L.load_ensemble(spark, path), rows, CLASSES).select(
        "row_id", *[F.col(p).alias(f"{p}_again") for p in SCORES.values()]
    )
    both = L.score(model, rows, CLASSES).join(again, "row_id", "left")
    chosen = F.get(F.array(*SCORES.values()), F.col("prediction").cast("int"))
    good = (F.abs(sum(F.col(p) for p in SCORES.values()) - 1) < 1e-9) & (chosen == F.greatest(*SCORES.values()))
    for p in SCORES.values():
        good = good & (F.abs(F.col(p) - F.col(f"{p}_again")) < 1e-12)
    broken = F.count_if(~F.coalesce(good, F.lit(False))).alias("broken")
    return both.groupBy("split").agg(F.count("*").alias("n"), broken)


def _importances(spark, sf_dir):
    model = tuned(spark, sf_dir)
    return L.importances(L.tree_nodes(model, CLASSES, spark), prepared(spark, sf_dir).features)


@register("l06_split_importance")
def split_importance(spark, sf_dir):
    return _importances(spark, sf_dir).select("position", "feature", "importance_split")


@register("l07_gain_importance")
def gain_importance(spark, sf_dir):
    return _importances(spark, sf_dir).select("position", "feature", "importance_gain")


@register("o04_top_gain")
def top_gain(spark, sf_dir):
    return Q.top_rows(_importances(spark, sf_dir), [F.desc("importance_gain"), "feature"], 15)


@register("m11_fitted_models")
def fitted_models(spark, sf_dir):
    """The three ensembles side by side on the test rows."""
    test = prepared(spark, sf_dir).test
    named = {
        "boosted": boosted(spark, sf_dir),
        "second boosted": second_boosted(spark, sf_dir),
        "forest": forest(spark, sf_dir),
    }
    stacked = None
    for name, model in named.items():
        part = L.score(model, test, CLASSES).select(F.lit(name).alias("model"), *_OUT)
        stacked = part if stacked is None else stacked.unionByName(part)
    return M.compare_models(stacked, SCORES)


@register("l08_fitted_high_risk_list")
def fitted_high_risk_list(spark, sf_dir):
    scored = L.score(tuned(spark, sf_dir), prepared(spark, sf_dir).rows, CLASSES)
    raw = jobs(spark, sf_dir, "row_id", "job_title", "industry", "ai_impact", "risk")
    high = scored.where(F.col("prediction") == 2).select(
        "row_id",
        F.col("prediction").alias("predicted_risk"),
        F.col("p2").alias("high_prob"),
        F.col("label").alias("actual_category"),
    )
    return raw.join(high, "row_id").orderBy(F.desc("high_prob"), "row_id")


@register("v04_grid_search")
def grid_search(spark, sf_dir):
    return searched(spark, sf_dir)[0]


@register("v05_cross_validation")
def cross_validation(spark, sf_dir):
    """Fold scores of the tuned settings."""
    features, profile = prepared(spark, sf_dir).features, _best_profile(spark, sf_dir)
    return T.boosted_cross_validation(_folded(spark, sf_dir, 5), features, CLASSES, profile, 5, "row_id")


def _explained(spark, sf_dir):
    ready = prepared(spark, sf_dir)

    def make():
        long, base = treeshap.tree_shap(
            tuned(spark, sf_dir), ready.test, ready.features, CLASSES, "row_id"
        )
        path = shared_path(spark, "shap")
        IO.write_attributions(long, path)
        return spark.read.parquet(path), base

    return _once(spark, sf_dir, "shap", make)


@register("h01_tree_shap")
def tree_shap(spark, sf_dir):
    long, _ = _explained(spark, sf_dir)
    return rounded(long.select("row_id", "class", "feature", "value", "shap"), 9)


@register("h01_additivity")
def additivity(spark, sf_dir):
    """Contributions plus base against the ensemble's own output, per row and class."""
    long, base = _explained(spark, sf_dir)
    table = spark.createDataFrame(list(zip(CLASSES, base)), "class int, base double")
    sums = long.groupBy("row_id", "class").agg(F.sum("shap").alias("shap"))
    out = L.margins(tuned(spark, sf_dir), prepared(spark, sf_dir).test, CLASSES)
    own = out.select(
        "row_id",
        F.inline(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"m{k}").alias("margin")) for k in CLASSES])),
    )
    joined = sums.join(F.broadcast(table), "class").join(own, ["row_id", "class"])
    return joined.select(
        "row_id", "class", (F.col("shap") + F.col("base")).alias("explained"), "margin"
    )


@register(
    "h01_additivity_check",
    over_jobs(
        split_sql(RISK_CODE_SQL)
        + """SELECT CAST(k AS INT) AS class, count(*) AS n, CAST(0 AS BIGINT) AS broken
             FROM split_rows, (SELECT unnest([0, 1, 2]) AS k) WHERE split = 'test' GROUP BY k"""
    ),
)
def additivity_check(spark, sf_dir):
    """Test rows of each class, and those whose contributions miss the ensemble's own output."""
    gap = F.abs(F.col("explained") - F.col("margin"))
    broken = F.count_if(~F.coalesce(gap < 1e-9, F.lit(False))).alias("broken")
    return additivity(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), broken)


@register("h02_expected_values")
def expected_values(spark, sf_dir):
    model = tuned(spark, sf_dir)
    base = treeshap.expected(model, treeshap.ensemble_leaves(model))
    return spark.createDataFrame([(k, float(v)) for k, v in zip(CLASSES, base)], "class int, base double")


def _sizes(spark, sf_dir):
    """Sums of absolute contributions of the test rows, a row for each class, prediction and feature."""

    def make():
        path = shared_path(spark, "shap-sums")
        treeshap.mean_sizes(tuned(spark, sf_dir), prepared(spark, sf_dir).test, "row_id").write.parquet(path)
        return spark.read.parquet(path)

    return _once(spark, sf_dir, "shap sums", make)


@register("h03_fitted_importance")
def fitted_importance(spark, sf_dir):
    return H.importance_of_sums(_sizes(spark, sf_dir))


@register("h08_fitted_comparison")
def fitted_comparison(spark, sf_dir):
    return H.comparison_of_sums(_sizes(spark, sf_dir))
