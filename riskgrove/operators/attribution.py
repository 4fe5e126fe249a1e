"""Aggregates and selections over a long attribution table.

The table has one row per (row_id, class, feature) with the feature's value and its
contribution ``shap``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskgrove.operators.ranks import attach_small
from riskgrove.operators.select import first_match, first_of_each


def class_importance(shap: DataFrame) -> DataFrame:
    return shap.groupBy("class", "feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def global_importance(shap: DataFrame) -> DataFrame:
    """Mean over classes of the mean absolute contribution, largest first."""
    return (
        class_importance(shap)
        .groupBy("feature")
        .agg(F.avg("mean_abs_shap").alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )


def importance_of_sums(sums: DataFrame) -> DataFrame:
    """``global_importance`` from the sums of ``treeshap.mean_sizes``."""
    per_class = sums.groupBy("class", "feature").agg((F.sum("total") / F.sum("n")).alias("m"))
    return (
        per_class.groupBy("feature")
        .agg(F.avg("m").alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )


def comparison_of_sums(sums: DataFrame, high: int = 2, low: int = 0) -> DataFrame:
    """``high_low_comparison`` from the sums of ``treeshap.mean_sizes``."""
    mean = F.col("total") / F.col("n")
    own = sums.where(F.col("class") == F.col("prediction"))
    means = own.groupBy("feature").agg(
        F.max(F.when(F.col("class") == high, mean)).alias("high_risk_abs_shap"),
        F.max(F.when(F.col("class") == low, mean)).alias("low_risk_abs_shap"),
    )
    return means.withColumn(
        "shap_diff", F.col("high_risk_abs_shap") - F.col("low_risk_abs_shap")
    ).orderBy(F.desc("shap_diff"), "feature")


def top_features(importance: DataFrame, n: int, value: str = "mean_abs_shap") -> DataFrame:
    """(feature, rank) of the n most important features; the table has a row per feature."""
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(value), "feature")
    return importance.select("feature", F.row_number().over(order).alias("rank")).where(
        F.col("rank") <= n
    )


def summary(shap: DataFrame, target_class: int, n: int = 20) -> DataFrame:
    """Value and contribution of every row for the class's top features."""
    one = shap.where(F.col("class") == target_class)
    top = top_features(class_importance(one).drop("class"), n)
    return attach_small(one, top, ["feature"]).select("row_id", "feature", "rank", "value", "shap")


def waterfall(
    shap: DataFrame, predictions: DataFrame, target_class: int, base: Column, fallback: int = 0, n: int = 15
) -> DataFrame:
    """The largest contributions to one class for the first row predicted as it.

    The remaining features are summed into one last row.
    """
    row = first_match(
        predictions.select("row_id", "prediction"), F.col("prediction") == target_class, "row_id", fallback
    )
    picked = shap.where(F.col("class") == target_class).join(
        F.broadcast(row.select("row_id")), "row_id"
    )
    ranked = picked.withColumn(
        "rank", F.row_number().over(W.partitionBy("row_id").orderBy(F.abs("shap").desc(), "feature"))
    )
    place = F.least(F.col("rank"), F.lit(n + 1))
    rest = place > n
    return ranked.groupBy("row_id", place.alias("rank")).agg(
        F.when(F.max("rank") > n, F.lit("rest")).otherwise(F.first("feature")).alias("feature"),
        F.when(F.max("rank") <= n, F.first("value")).alias("value"),
        F.sum("shap").alias("shap"),
    ).withColumn("base", base)


def dependence(shap: DataFrame, target_class: int, n: int = 4) -> DataFrame:
    """Value against contribution for the overall top features, one class."""
    top = top_features(global_importance(shap), n)
    one = shap.where(F.col("class") == target_class)
    return attach_small(one, top, ["feature"]).select("feature", "row_id", "value", "shap")


def interaction_partner(shap: DataFrame, target_class: int, n: int = 4, bins: int = 20) -> DataFrame:
    """For each top feature the other feature that best tells its contribution apart.

    Within bins of the feature's own value, the absolute correlation of its contribution
    with the other feature's value is averaged; the largest average wins.
    """
    one = shap.where(F.col("class") == target_class)
    top = top_features(global_importance(shap), n)
    main = attach_small(one, top, ["feature"]).select("row_id", "feature", "value", "shap")
    ends = main.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    binned = attach_small(main, ends, ["feature"]).select(
        "row_id",
        "feature",
        "shap",
        F.least(F.coalesce(F.floor((F.col("value") - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1)).alias("bin"),
    )
    others = one.select("row_id", F.col("feature").alias("other"), F.col("value").alias("other_value"))
    pairs = binned.join(others, "row_id").where(F.col("feature") != F.col("other"))
    link = F.try_divide(
        F.covar_pop("shap", "other_value"), F.stddev_pop("shap") * F.stddev_pop("other_value")
    )
    per_bin = pairs.groupBy("feature", "other", "bin").agg(
        F.coalesce(F.abs(link), F.lit(0.0)).alias("r"), F.count("*").alias("m")
    )
    scores = per_bin.groupBy("feature", "other").agg(
        (F.sum(F.col("r") * F.col("m")) / F.sum("m")).alias("strength")
    )
    best = F.max(F.struct(F.col("strength"), F.col("other")))
    return scores.groupBy("feature").agg(best.alias("b")).select(
        "feature", F.col("b.other").alias("partner"), F.col("b.strength").alias("strength")
    )


def force(
    shap: DataFrame, predictions: DataFrame, target_class: int, pick: list[int], n: int = 5
) -> DataFrame:
    """Contributions to one class of the first rows of some predicted classes, with their sign."""
    chosen = first_of_each(predictions.select("row_id", "prediction"), "prediction", pick, "row_id", n)
    rows = shap.where(F.col("class") == target_class).join(F.broadcast(chosen), "row_id")
    side = F.when(F.col("shap") > 0, "up").when(F.col("shap") < 0, "down").otherwise("none")
    return rows.select("row_id", "prediction", "feature", "value", "shap", side.alias("side"))


def high_low_comparison(
    shap: DataFrame, predictions: DataFrame, high: int = 2, low: int = 0
) -> DataFrame:
    """Mean absolute contribution to the high class over rows predicted high, the same for
    the low class over rows predicted low, and the difference, largest first."""
    own = (
        shap.where(F.col("class").isin(high, low))
        .join(predictions.select("row_id", "prediction"), "row_id")
        .where(F.col("class") == F.col("prediction"))
    )
    size = F.abs("shap")
    means = own.groupBy("feature").agg(
        F.avg(F.when(F.col("class") == high, size)).alias("high_risk_abs_shap"),
        F.avg(F.when(F.col("class") == low, size)).alias("low_risk_abs_shap"),
    )
    return means.withColumn(
        "shap_diff", F.col("high_risk_abs_shap") - F.col("low_risk_abs_shap")
    ).orderBy(F.desc("shap_diff"), "feature")
