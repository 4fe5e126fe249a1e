"""Attribution queries over a deterministic attribution table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrove.catalog.registry import over_jobs, r, register, rounded
from riskgrove.catalog.selection import SCORED_SQL, scored
from riskgrove.operators import attribution as H, select as Q
from riskgrove.operators.common import one_row
from riskgrove.sources import schema as S
from riskgrove.sources.tables import jobs

_LONG = " UNION ALL ".join(
    f"SELECT row_id, {k} AS class, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
    f"({c} - (SELECT avg({c}) FROM jobs)) * {k + 1} / 1000 AS shap FROM jobs"
    for c in S.NUMERIC
    for k in S.RISK_CODES
)
_SHAP = f", shap AS ({_LONG})"
_IMPORTANCE = """, per_class AS (SELECT class, feature, avg(abs(shap)) AS m FROM shap GROUP BY class, feature),
    importance AS (SELECT feature, avg(m) AS m FROM per_class GROUP BY feature),
    top AS (SELECT feature, row_number() OVER (ORDER BY m DESC, feature) AS rank FROM importance) """


def shap_table(spark, sf_dir, *keep: str):
    """(row_id, class, feature, value, shap) with shap = (value - mean) * (class + 1) / 1000,
    and the scored columns asked for."""
    wide = scored(spark, sf_dir, "row_id", *S.NUMERIC, heavy=True)
    means = one_row(wide, **{c: F.avg(c) for c in S.NUMERIC})
    cells = [
        F.struct(
            F.lit(k).alias("class"),
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("value"),
            ((F.col(c) - F.col(f"__{c}")) * (k + 1) / 1000).alias("shap"),
        )
        for c in S.NUMERIC
        for k in S.RISK_CODES
    ]
    wide = wide.withColumns({f"__{c}": means.getField(c) for c in S.NUMERIC})
    return wide.select("row_id", *keep, F.inline(F.array(*cells)))


def predictions(spark, sf_dir):
    return scored(spark, sf_dir, "row_id").select("row_id", "prediction")


@register("h03_global_importance", over_jobs(_SHAP + _IMPORTANCE + f"SELECT feature, {r('m')} AS mean_abs_shap FROM importance"))
def global_importance(spark, sf_dir):
    return rounded(H.global_importance(shap_table(spark, sf_dir)))


@register("h03_class_importance", over_jobs(_SHAP + _IMPORTANCE + f"SELECT class, feature, {r('m')} AS mean_abs_shap FROM per_class"))
def class_importance(spark, sf_dir):
    return rounded(H.class_importance(shap_table(spark, sf_dir)))


@register(
    "h04_summary",
    over_jobs(
        _SHAP
        + _IMPORTANCE
        + f""", best AS (SELECT feature, row_number() OVER (ORDER BY m DESC, feature) AS rank FROM per_class WHERE class = 2)
        SELECT row_id, feature, CAST(rank AS INT) AS rank, {r('value')} AS value, {r('shap')} AS shap
        FROM shap JOIN best USING (feature) WHERE class = 2 AND rank <= 20"""
    ),
)
def summary(spark, sf_dir):
    return rounded(H.summary(shap_table(spark, sf_dir), 2))


def _waterfall_sql(target: int) -> str:
    return over_jobs(
        f""", {SCORED_SQL}{_SHAP}, hit AS (SELECT row_id FROM scored WHERE prediction = {target} ORDER BY row_id LIMIT 1),
        ranked AS (SELECT shap.*, row_number() OVER (ORDER BY abs(shap) DESC, feature) AS rn FROM shap JOIN hit USING (row_id)
                   WHERE class = {target})
        SELECT row_id, CAST(least(rn, 16) AS INT) AS rank, CASE WHEN least(rn, 16) > 15 THEN 'rest' ELSE any_value(feature) END AS feature,
               {r('coalesce(CASE WHEN least(rn, 16) <= 15 THEN any_value(value) END, -1e0)')} AS value, {r('sum(shap)')} AS shap,
               {r('(SELECT avg(risk) FROM jobs)')} AS base
        FROM ranked GROUP BY row_id, least(rn, 16)"""
    )


def _waterfall(spark, sf_dir, target, fallback):
    base = jobs(spark, sf_dir, "risk").agg(F.avg("risk")).scalar()
    out = H.waterfall(shap_table(spark, sf_dir), predictions(spark, sf_dir), target, base, fallback)
    return rounded(out.withColumn("value", F.coalesce("value", F.lit(-1.0))))


@register("h05_waterfall_high", _waterfall_sql(2))
def waterfall_high(spark, sf_dir):
    return _waterfall(spark, sf_dir, 2, 0)


@register("h05_waterfall_low", _waterfall_sql(0))
def waterfall_low(spark, sf_dir):
    return _waterfall(spark, sf_dir, 0, 1)


@register(
    "h06_dependence",
    over_jobs(
        _SHAP
        + _IMPORTANCE
        + f"""SELECT feature, row_id, {r('value')} AS value, {r('shap')} AS shap FROM shap JOIN top USING (feature)
              WHERE class = 2 AND rank <= 4"""
    ),
)
def dependence(spark, sf_dir):
    return rounded(H.dependence(shap_table(spark, sf_dir), 2, n=4))


@register("h06_interaction_partner")
def interaction_partner(spark, sf_dir):
    return rounded(H.interaction_partner(shap_table(spark, sf_dir), 2, n=4))


@register(
    "h07_force",
    over_jobs(
        f""", {SCORED_SQL}{_SHAP}, firsts AS (SELECT row_id, prediction, row_number() OVER (PARTITION BY prediction ORDER BY row_id) AS rn
              FROM scored WHERE prediction IN (0, 2))
        SELECT row_id, prediction, feature, {r('value')} AS value, {r('shap')} AS shap,
               CASE WHEN shap > 0 THEN 'up' WHEN shap < 0 THEN 'down' ELSE 'none' END AS side
        FROM shap JOIN firsts USING (row_id) WHERE class = 2 AND rn <= 5"""
    ),
)
def force(spark, sf_dir):
    return rounded(H.force(shap_table(spark, sf_dir), predictions(spark, sf_dir), 2, [2, 0], 5))


_COMPARE = (
    f""", {SCORED_SQL}{_SHAP}, own AS (SELECT shap.* FROM shap JOIN scored USING (row_id) WHERE class = prediction AND class IN (0, 2)),
    compared AS (SELECT feature, avg(CASE WHEN class = 2 THEN abs(shap) END) AS h, avg(CASE WHEN class = 0 THEN abs(shap) END) AS l
                 FROM own GROUP BY feature) """
)


@register(
    "h08_high_low_comparison",
    over_jobs(_COMPARE + f"SELECT feature, {r('h')} AS high_risk_abs_shap, {r('l')} AS low_risk_abs_shap, {r('h - l')} AS shap_diff FROM compared"),
)
def high_low_comparison(spark, sf_dir):
    return rounded(H.high_low_comparison(shap_table(spark, sf_dir), predictions(spark, sf_dir)))


@register(
    "o05_top_differences",
    over_jobs(_COMPARE + f"SELECT feature, {r('h - l')} AS shap_diff FROM compared ORDER BY abs(h - l) DESC, feature LIMIT 15"),
)
def top_differences(spark, sf_dir):
    table = H.high_low_comparison(shap_table(spark, sf_dir), predictions(spark, sf_dir))
    return rounded(Q.top_absolute(table.select("feature", "shap_diff"), "shap_diff", "feature", 15))
