"""Split and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrove.catalog.profiles import split_jobs, split_sql
from riskgrove.catalog.features import TERTILE_CTE
from riskgrove.catalog.registry import RISK_CODE_SQL, over_jobs, r, register, rounded, settled
from riskgrove.catalog.selection import SCORED_SQL, scored
from riskgrove.functions.binning import cut, qcut
from riskgrove.operators import evaluate as M, select as Q, split as V
from riskgrove.sources import schema as S
from riskgrove.sources.tables import jobs

SCORES = {0: "p0", 1: "p1", 2: "p2"}


@register("v01_stratified_split", over_jobs(split_sql(RISK_CODE_SQL) + "SELECT row_id, label, split FROM split_rows"))
def stratified_split(spark, sf_dir):
    return split_jobs(spark, sf_dir).select("row_id", "label", "split")


@register(
    "v02_tertile_split",
    over_jobs(
        TERTILE_CTE
        + split_sql("CASE WHEN risk <= t1 THEN 0 WHEN risk <= t2 THEN 1 ELSE 2 END").replace(
            "AS label FROM jobs)", "AS label FROM jobs, e)"
        )
        + "SELECT row_id, label, split FROM split_rows"
    ),
)
def tertile_split(spark, sf_dir):
    rows = qcut(jobs(spark, sf_dir, "row_id", "risk"), "risk", 3, [0, 1, 2], "label")
    return V.stratified_split(rows, "label", "row_id").select("row_id", "label", "split")


def _folds_sql(k: int) -> str:
    return over_jobs(
        split_sql(RISK_CODE_SQL) + f"SELECT row_id, label, CAST((place - 1) % {k} AS INT) AS fold FROM split_rows"
    )


def _folds(spark, sf_dir, k):
    rows = jobs(spark, sf_dir, "row_id", "risk").select(
        "row_id", cut("risk", S.RISK_EDGES, S.RISK_CODES).alias("label")
    )
    return V.stratified_folds(rows, "label", "row_id", k)


@register("v03_folds_3", _folds_sql(3))
def folds_3(spark, sf_dir):
    return _folds(spark, sf_dir, 3)


@register("v03_folds_5", _folds_sql(5))
def folds_5(spark, sf_dir):
    return _folds(spark, sf_dir, 5)


def _metrics_cte(source: str = "scored", by: str = "") -> str:
    """CTEs ``classes`` (per class) and ``overall`` (one row per group)."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f""", sides AS (
        SELECT {keys}label AS class, 1 AS s, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS t FROM {source}
        UNION ALL SELECT {keys}prediction, 0, 1, 0 FROM {source}),
    sums AS (SELECT {keys}class, CAST(sum(s) AS BIGINT) AS support, sum(p) AS predicted, sum(t) AS tp
             FROM sides GROUP BY {keys}class),
    classes AS (SELECT {keys}class, support, tp,
        CASE WHEN predicted = 0 THEN 0e0 ELSE tp * 1e0 / predicted END AS precision,
        CASE WHEN support = 0 THEN 0e0 ELSE tp * 1e0 / support END AS recall,
        CASE WHEN support + predicted = 0 THEN 0e0 ELSE 2e0 * tp / (support + predicted) END AS f1 FROM sums),
    overall AS (SELECT {keys}CAST(sum(support) AS BIGINT) AS support, sum(tp) * 1e0 / sum(support) AS accuracy,
        avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
        sum(precision * support) / sum(support) AS weighted_precision,
        sum(recall * support) / sum(support) AS weighted_recall,
        sum(f1 * support) / sum(support) AS weighted_f1 FROM classes {group}) """


_METRICS = {
    "m01_accuracy": "accuracy",
    "m02_macro_precision": "macro_precision",
    "m03_macro_recall": "macro_recall",
    "m04_macro_f1": "macro_f1",
    "m05_weighted_f1": "weighted_f1",
}


def _register_metric(name: str, column: str) -> None:
    def build(spark, sf_dir):
        return rounded(M.metrics(scored(spark, sf_dir)).select(column))

    register(
        name, over_jobs(f", {SCORED_SQL}{_metrics_cte()} SELECT {r(column)} AS {column} FROM overall")
    )(build)


for _name, _column in _METRICS.items():
    _register_metric(_name, _column)


def _auc_cte(source: str = "scored", by: str = "") -> str:
    keys = f"{by}, " if by else ""
    long = " UNION ALL ".join(
        f"SELECT {keys}{k} AS class, {c} AS score, label = {k} AS pos FROM {source}" for k, c in SCORES.items()
    )
    return f""", one_rest AS ({long}),
    ranked AS (SELECT *, rank() OVER (PARTITION BY {keys}class ORDER BY score)
        + (count(*) OVER (PARTITION BY {keys}class, score) - 1) / 2e0 AS rk FROM one_rest),
    pieces AS (SELECT {keys}class, sum(CASE WHEN pos THEN rk END) AS r1, count(CASE WHEN pos THEN 1 END) * 1e0 AS n1,
               count(CASE WHEN NOT pos THEN 1 END) * 1e0 AS n0 FROM ranked GROUP BY {keys}class),
    aucs AS (SELECT {keys}class, (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM pieces) """


@register("m06_auc_per_class", over_jobs(f", {SCORED_SQL}{_auc_cte()} SELECT class, {r('auc')} AS auc FROM aucs"))
def auc_per_class(spark, sf_dir):
    return rounded(M.auc(scored(spark, sf_dir, heavy=True), SCORES))


@register("m06_macro_auc", over_jobs(f", {SCORED_SQL}{_auc_cte()} SELECT {r('avg(auc)')} AS macro_auc FROM aucs"))
def macro_auc(spark, sf_dir):
    return rounded(M.macro_auc(scored(spark, sf_dir, heavy=True), SCORES))


_CONFUSION_CTE = f""", {SCORED_SQL}, grid AS (SELECT a.range AS label, b.range AS prediction FROM range(3) a, range(3) b),
    cells AS (SELECT CAST(g.label AS INT) AS label, CAST(g.prediction AS INT) AS prediction, count(s.label) AS n
              FROM grid g LEFT JOIN scored s ON s.label = g.label AND s.prediction = g.prediction
              GROUP BY g.label, g.prediction) """


@register("m07_confusion", over_jobs(_CONFUSION_CTE + "SELECT label, prediction, n FROM cells"))
def confusion(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir), S.RISK_CODES).drop("share")


@register(
    "m08_confusion_shares",
    over_jobs(
        _CONFUSION_CTE
        + f"SELECT label, prediction, {r('n * 1e0 / sum(n) OVER (PARTITION BY label)')} AS share FROM cells"
    ),
)
def confusion_shares(spark, sf_dir):
    return rounded(M.confusion(scored(spark, sf_dir), S.RISK_CODES).drop("n"))


@register(
    "m09_roc",
    over_jobs(
        f""", {SCORED_SQL}{_auc_cte()}, c AS (SELECT class, score, count(CASE WHEN pos THEN 1 END) AS p,
              count(CASE WHEN NOT pos THEN 1 END) AS q FROM one_rest GROUP BY class, score),
        w AS (SELECT class, score, sum(p) OVER d * 1e0 / sum(p) OVER a AS tpr, sum(q) OVER d * 1e0 / sum(q) OVER a AS fpr
              FROM c WINDOW d AS (PARTITION BY class ORDER BY score DESC), a AS (PARTITION BY class))
        SELECT class, {r('score', 9)} AS threshold, {r('fpr')} AS fpr, {r('tpr')} AS tpr FROM w"""
    ),
)
def roc(spark, sf_dir):
    points = M.roc(scored(spark, sf_dir, heavy=True), SCORES)
    return points.select(
        "class",
        settled("threshold", 9).alias("threshold"),
        settled("fpr", 6).alias("fpr"),
        settled("tpr", 6).alias("tpr"),
    )


@register(
    "m10_report",
    over_jobs(
        f""", {SCORED_SQL}{_metrics_cte()}
        SELECT CAST(class AS VARCHAR) AS name, {r('precision')} AS precision, {r('recall')} AS recall,
               {r('f1')} AS f1, support FROM classes
        UNION ALL SELECT 'accuracy', {r('accuracy')}, {r('accuracy')}, {r('accuracy')}, support FROM overall
        UNION ALL SELECT 'macro avg', {r('macro_precision')}, {r('macro_recall')}, {r('macro_f1')}, support FROM overall
        UNION ALL SELECT 'weighted avg', {r('weighted_precision')}, {r('weighted_recall')}, {r('weighted_f1')}, support
        FROM overall"""
    ),
)
def report(spark, sf_dir):
    return rounded(M.report(scored(spark, sf_dir)))


_MODELS_CTE = f""", {SCORED_SQL}, models AS (
    SELECT 'salary first' AS model, row_id, label, prediction, p0, p1, p2 FROM scored
    UNION ALL SELECT 'diversity first', row_id, label,
        CASE WHEN diversity / 100 >= 0.5e0 THEN 2 WHEN remote >= 50 THEN 1 ELSE 0 END, 1 - remote / 100, remote / 100,
        diversity / 100 FROM scored)"""


def _models(spark, sf_dir):
    rows = scored(spark, sf_dir, "row_id", "remote", "diversity", heavy=True)
    first = rows.select(F.lit("salary first").alias("model"), "row_id", "label", "prediction", "p0", "p1", "p2")
    second = rows.select(
        F.lit("diversity first").alias("model"),
        "row_id",
        "label",
        F.when(F.col("diversity") / 100 >= 0.5, 2).when(F.col("remote") >= 50, 1).otherwise(0).alias("prediction"),
        (1 - F.col("remote") / 100).alias("p0"),
        (F.col("remote") / 100).alias("p1"),
        (F.col("diversity") / 100).alias("p2"),
    )
    return first.unionByName(second)


@register(
    "m11_compare_models",
    over_jobs(
        f"""{_MODELS_CTE}{_metrics_cte('models', 'model')}{_auc_cte('models', 'model')},
        mean_auc AS (SELECT model, avg(auc) AS macro_auc FROM aucs GROUP BY model)
        SELECT model, {', '.join(f'{r(c)} AS {c}' for c in [*_METRICS.values(), 'macro_auc'])}
        FROM overall JOIN mean_auc USING (model)"""
    ),
)
def compare_models(spark, sf_dir):
    return rounded(M.compare_models(_models(spark, sf_dir), SCORES))


@register(
    "m11_best_model",
    over_jobs(
        f"""{_MODELS_CTE}{_metrics_cte('models', 'model')}
        SELECT model, {r('macro_f1')} AS macro_f1 FROM overall ORDER BY overall.macro_f1 DESC LIMIT 1"""
    ),
)
def best_model(spark, sf_dir):
    table = M.metrics(_models(spark, sf_dir), ["model"]).select("model", "macro_f1")
    return rounded(Q.best_row(table, "macro_f1"))


@register(
    "m11_best_predictions",
    over_jobs(
        f"""{_MODELS_CTE}{_metrics_cte('models', 'model')},
        best AS (SELECT model FROM overall ORDER BY macro_f1 DESC LIMIT 1)
        SELECT model, row_id, prediction FROM models WHERE model IN (SELECT model FROM best)"""
    ),
)
def best_predictions(spark, sf_dir):
    return M.best_predictions(_models(spark, sf_dir)).select("model", "row_id", "prediction")


@register(
    "l05_argmax",
    over_jobs(f", {SCORED_SQL} SELECT row_id, prediction FROM scored"),
)
def argmax(spark, sf_dir):
    return scored(spark, sf_dir, "row_id").select("row_id", "prediction")


@register(
    "l08_high_risk_list",
    over_jobs(
        f""", {SCORED_SQL} SELECT row_id, job_title, industry, ai_impact, {r('risk')} AS risk, prediction AS predicted_risk,
            {r('p2')} AS high_prob, label AS actual_category FROM scored WHERE prediction = 2"""
    ),
)
def high_risk_list(spark, sf_dir):
    rows = scored(spark, sf_dir, "row_id", "job_title", "industry", "ai_impact", "risk")
    listed = rows.where(F.col("prediction") == 2).orderBy(F.desc("p2"), "row_id")
    return rounded(
        listed.select(
            "row_id",
            "job_title",
            "industry",
            "ai_impact",
            "risk",
            F.col("prediction").alias("predicted_risk"),
            F.col("p2").alias("high_prob"),
            F.col("label").alias("actual_category"),
        )
    )


@register(
    "l09_list_distribution",
    over_jobs(
        f""", {SCORED_SQL} SELECT 'industry' AS dimension, industry AS level, count(*) AS n FROM scored
            WHERE prediction = 2 GROUP BY industry
            UNION ALL SELECT 'ai_impact', ai_impact, count(*) FROM scored WHERE prediction = 2 GROUP BY ai_impact"""
    ),
)
def list_distribution(spark, sf_dir):
    rows = scored(spark, sf_dir, "industry", "ai_impact").where(F.col("prediction") == 2)
    long = rows.select("industry", "ai_impact").unpivot([], ["industry", "ai_impact"], "dimension", "level")
    return long.groupBy("dimension", "level").agg(F.count("*").alias("n"))
