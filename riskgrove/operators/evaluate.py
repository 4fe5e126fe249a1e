"""Multiclass evaluation from (label, prediction, score per class) tables.

Every function accepts ``by``, the columns that tell several models apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.operators.common import one_row
from riskgrove.operators.ranks import running_counts


def argmax(scores: list[Column]) -> Column:
    """Index of the largest score; the first one on ties."""
    values = F.array(*scores)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confusion(rows: DataFrame, classes: list[int], by: list[str] | None = None) -> DataFrame:
    """(label, prediction, n, share): counts over the full grid, and shares of each label."""
    by = by or []
    counts = rows.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    codes = F.array(*[F.lit(c) for c in classes])
    grid = groups.withColumn("label", F.explode(codes)).withColumn("prediction", F.explode(codes))
    cells = grid.join(counts, [*by, "label", "prediction"], "left").select(
        *by, "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )
    support = counts.groupBy(*by, "label").agg(F.sum("n").alias("support"))
    return cells.join(support, [*by, "label"], "left").select(
        *by,
        "label",
        "prediction",
        "n",
        F.coalesce(F.try_divide(F.col("n"), F.col("support")), F.lit(0.0)).alias("share"),
    )


def per_class(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; a class never predicted has precision 0."""
    by = by or []
    counts = rows.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = counts.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.col("n").alias("support"),
                    zero.alias("predicted"),
                    hit.alias("tp"),
                ),
                F.struct(
                    F.col("prediction").alias("class"),
                    zero.alias("support"),
                    F.col("n").alias("predicted"),
                    zero.alias("tp"),
                ),
            )
        ),
    )
    sums = sides.groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )
    part = lambda bottom: F.coalesce(F.try_divide(F.col("tp"), bottom), F.lit(0.0))
    return sums.select(
        *by,
        "class",
        part(F.col("predicted")).alias("precision"),
        part(F.col("support")).alias("recall"),
        part((F.col("predicted") + F.col("support")) / 2).alias("f1"),
        "support",
        "tp",
    )


def metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro precision, macro recall, macro F1 and support-weighted F1."""
    by = by or []
    return per_class(rows, by).groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def report(rows: DataFrame) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted rows."""
    classes = per_class(rows)
    fields = ["precision", "recall", "f1"]
    total = F.sum("support")
    single = classes.select(F.col("class").cast("string").alias("name"), *fields, "support")
    accuracy = F.sum("tp") / total
    overall = classes.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("name"),
                *[accuracy.alias(f) for f in fields],
                total.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("name"),
                *[F.avg(f).alias(f) for f in fields],
                total.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("name"),
                *[(F.sum(F.col(f) * F.col("support")) / total).alias(f) for f in fields],
                total.alias("support"),
            ),
        ).alias("r")
    ).select(F.inline("r"))
    return single.unionByName(overall)


def _score_counts(rows: DataFrame, scores: dict[int, str], by: list[str]) -> DataFrame:
    """(by, class, score, pos, neg): label counts per distinct score, one class against the rest."""
    long = rows.select(
        *by,
        "label",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("class"), F.col(c).cast("double").alias("score"))
                    for k, c in scores.items()
                ]
            )
        ),
    )
    return long.groupBy(*by, "class", "score").agg(
        F.count_if(F.col("label") == F.col("class")).alias("pos"),
        F.count_if(F.col("label") != F.col("class")).alias("neg"),
    )


def auc(rows: DataFrame, scores: dict[int, str], by: list[str] | None = None) -> DataFrame:
    """One-vs-rest area under the ROC curve per class, by the rank form."""
    by = by or []
    counts = _score_counts(rows, scores, by)
    ran = running_counts(counts, [*by, "class"], "score", {"neg_before": "neg"})
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    sums = ran.groupBy(*by, "class").agg(
        F.sum(won).alias("won"),
        F.sum("pos").cast("double").alias("n_pos"),
        F.sum("neg").cast("double").alias("n_neg"),
    )
    return sums.select(
        *by, "class", F.try_divide(F.col("won"), F.col("n_pos") * F.col("n_neg")).alias("auc")
    )


def macro_auc(rows: DataFrame, scores: dict[int, str], by: list[str] | None = None) -> DataFrame:
    by = by or []
    return auc(rows, scores, by).groupBy(*by).agg(F.avg("auc").alias("macro_auc"))


def roc(rows: DataFrame, scores: dict[int, str], by: list[str] | None = None) -> DataFrame:
    """ROC points per class: at each threshold the rates of rows scored at least as high."""
    by = by or []
    counts = _score_counts(rows, scores, by)
    ran = running_counts(
        counts, [*by, "class"], "score", {"neg_before": "neg", "pos_before": "pos"}
    )
    rate = lambda side: F.try_divide(
        F.col(f"{side}_before_all") - F.col(f"{side}_before"), F.col(f"{side}_before_all")
    )
    return ran.select(
        *by, "class", F.col("score").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr")
    )


def compare_models(rows: DataFrame, scores: dict[int, str], model: str = "model") -> DataFrame:
    """One metric row per model."""
    return metrics(rows, [model]).join(macro_auc(rows, scores, [model]), model)


def best_predictions(rows: DataFrame, metric: str = "macro_f1", model: str = "model") -> DataFrame:
    """The prediction rows of the model that is best by a metric of ``metrics``."""
    table = metrics(rows, [model])
    winner = one_row(table, name=F.max_by(F.col(model), F.col(metric))).getField("name")
    return rows.where(F.col(model) == winner)
