"""Derived columns, bins and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrove.catalog.registry import (
    GROWTH_SQL,
    over_jobs,
    r,
    register,
    rounded,
    sql_cut,
    sql_lookup,
)
from riskgrove.functions import binning as B, columns as C
from riskgrove.operators import encode as E
from riskgrove.sources import schema as S
from riskgrove.sources.tables import jobs

_IMPACT_RANK = sql_lookup("ai_impact", {x: i + 1 for i, x in enumerate(S.IMPACT_ORDER)})

# id -> (column, the inputs it reads, SQL twin)
_DERIVED = {
    "x01": ("growth_rate", ["openings_now", "openings_future"], GROWTH_SQL),
    "x02": ("salary_per_experience", ["salary", "experience"], "salary / (experience + 1)"),
    "x03": ("job_density", ["openings_now", "experience"], "openings_now * 1e0 / (experience + 1)"),
    "x04": ("salary_remote_interaction", ["salary", "remote"], "salary * remote / 100"),
    "x05": (
        "growth_impact_interaction",
        ["openings_now", "openings_future", "ai_impact"],
        f"{GROWTH_SQL} * {_IMPACT_RANK}",
    ),
    "x06": ("salary_experience_interaction", ["salary", "experience"], "salary * experience"),
    "x07": (
        "diversity_growth_interaction",
        ["diversity", "openings_now", "openings_future"],
        f"diversity * {GROWTH_SQL}",
    ),
    "x08": (
        "remote_growth_interaction",
        ["remote", "openings_now", "openings_future"],
        f"remote * {GROWTH_SQL}",
    ),
}


DERIVED_SQL = {name: sql for name, _, sql in _DERIVED.values()}


def _register_derived(code: str, name: str, inputs: list[str], sql: str) -> None:
    # Only the inputs are read, so the other interactions' columns need not exist.
    def build(spark, sf_dir):
        rows = jobs(spark, sf_dir, "row_id", *inputs)
        return rounded(rows.select("row_id", C.interactions()[name].alias(name)))

    register(f"{code}_{name}", over_jobs(f"SELECT row_id, {r(sql)} AS {name} FROM jobs"))(build)


for _code, (_name, _inputs, _sql) in _DERIVED.items():
    _register_derived(_code, _name, _inputs, _sql)


@register(
    "x09_salary_zscore",
    over_jobs(
        f"""SELECT row_id, {r('(salary - (SELECT avg(salary) FROM jobs)) / (SELECT stddev_samp(salary) FROM jobs)')}
            AS salary_zscore FROM jobs"""
    ),
)
def salary_zscore(spark, sf_dir):
    rows = E.z_score(jobs(spark, sf_dir, "row_id", "salary"), "salary", "salary_zscore")
    return rounded(rows.select("row_id", "salary_zscore"))


@register(
    "x11_fill_missing",
    over_jobs(
        f"""SELECT row_id, coalesce({sql_lookup('education', {'High School': 0, 'Associate Degree': 1, 'PhD': 4})}, 0)
              AS education_encoded, {r('coalesce(salary / nullif(diversity, 0), 0e0)')} AS per_point FROM jobs"""
    ),
)
def fill_missing(spark, sf_dir):
    rows = jobs(spark, sf_dir, "row_id", "education", "salary", "diversity").select(
        "row_id",
        C.education_code("education", "strict").alias("education_encoded"),
        F.try_divide("salary", "diversity").alias("per_point"),
    )
    return rounded(E.fill_missing(rows, ["education_encoded", "per_point"]))


_DIVERSITY_SQL = sql_cut("diversity", S.DIVERSITY_EDGES, S.DIVERSITY_ITEMS)


@register(
    "x12_casts",
    over_jobs(
        f"""SELECT row_id, CAST(experience AS VARCHAR) AS experience_text, coalesce({_DIVERSITY_SQL}, 'nan')
            AS diversity_text, CAST(floor(risk) AS INT) AS risk_whole, CAST(openings_now AS DOUBLE) AS openings
            FROM jobs"""
    ),
)
def casts(spark, sf_dir):
    level = B.cut("diversity", S.DIVERSITY_EDGES, S.DIVERSITY_ITEMS)
    return jobs(spark, sf_dir, "row_id", "experience", "diversity", "risk", "openings_now").select(
        "row_id",
        F.col("experience").cast("string").alias("experience_text"),
        F.coalesce(level.cast("string"), F.lit("nan")).alias("diversity_text"),
        F.floor("risk").cast("int").alias("risk_whole"),
        F.col("openings_now").cast("double").alias("openings"),
    )


@register(
    "x13_round_half_even",
    over_jobs("SELECT row_id, round_even(openings_now / 8e0, 2) AS eighths FROM jobs"),
)
def round_half_even(spark, sf_dir):
    rows = jobs(spark, sf_dir, "row_id", "openings_now")
    return rows.select("row_id", F.bround(F.col("openings_now") / 8.0, 2).alias("eighths"))


# id -> (output, inputs, edges, labels, value in SQL)
_GROWTH_INPUTS = ["openings_now", "openings_future"]
_BINS = {
    "b01_risk_names": ("risk", ["risk"], S.RISK_EDGES, S.RISK_NAMES),
    "b01_risk_items": ("risk", ["risk"], S.RISK_EDGES, S.RISK_ITEMS),
    "b02_experience_levels": ("experience", ["experience"], S.EXPERIENCE_EDGES, S.EXPERIENCE_LEVELS),
    "b03_salary_levels": ("salary", ["salary"], S.SALARY_EDGES, S.SALARY_LEVELS),
    "b04_remote_levels": ("remote", ["remote"], S.REMOTE_EDGES, S.REMOTE_LEVELS),
    "b05_diversity_levels": ("diversity", ["diversity"], S.DIVERSITY_EDGES, S.DIVERSITY_ITEMS),
    "b06_growth_levels": (None, _GROWTH_INPUTS, S.GROWTH_EDGES, S.GROWTH_LEVELS),
    "b06_growth_labels": (None, _GROWTH_INPUTS, S.GROWTH_EDGES, S.GROWTH_LABELS),
}


def _register_bins(name, column, inputs, edges, labels) -> None:
    def build(spark, sf_dir):
        value = C.growth_rate() if column is None else F.col(column)
        label = F.coalesce(B.cut(value, edges, labels), F.lit("(none)"))
        return jobs(spark, sf_dir, "row_id", *inputs).select("row_id", label.alias("level"))

    sql = sql_cut(column or GROWTH_SQL, edges, labels)
    register(name, over_jobs(f"SELECT row_id, coalesce({sql}, '(none)') AS level FROM jobs"))(build)


for _name, _spec in _BINS.items():
    _register_bins(_name, *_spec)


@register(
    "b01_risk_codes",
    over_jobs(f"SELECT row_id, {sql_cut('risk', S.RISK_EDGES, S.RISK_CODES)} AS risk_category_equal FROM jobs"),
)
def risk_codes(spark, sf_dir):
    rows = jobs(spark, sf_dir, "row_id", "risk")
    return rows.select("row_id", B.cut("risk", S.RISK_EDGES, S.RISK_CODES).alias("risk_category_equal"))


TERTILE_CTE = """, e AS (SELECT quantile_cont(risk, 1e0 / 3) AS t1, quantile_cont(risk, 2e0 / 3) AS t2 FROM jobs)"""


@register(
    "b07_risk_tertiles",
    over_jobs(
        TERTILE_CTE
        + """ SELECT row_id, CASE WHEN risk <= t1 THEN 0 WHEN risk <= t2 THEN 1 ELSE 2 END AS risk_category_quantile
              FROM jobs, e"""
    ),
)
def risk_tertiles(spark, sf_dir):
    rows = jobs(spark, sf_dir, "row_id", "risk")
    return B.qcut(rows, "risk", 3, [0, 1, 2], "risk_category_quantile").drop("risk")


_ORDERS = {
    "k01_education": ("education_encoded", ["education"], sql_lookup("education", {x: i for i, x in enumerate(S.EDUCATION_ORDER)})),
    "k02_ai_impact": ("impact_encoded", ["ai_impact"], sql_lookup("ai_impact", {x: i for i, x in enumerate(S.IMPACT_ORDER)})),
    "k03_job_status": ("status_encoded", ["job_status"], sql_lookup("job_status", {x: i for i, x in enumerate(S.STATUS_ORDER)})),
    "k04_experience_level": ("experience_level_encoded", ["experience"], sql_cut("experience", S.EXPERIENCE_EDGES, [0, 1, 2, 3, 4])),
    "k05_salary_level": ("salary_level_encoded", ["salary"], sql_cut("salary", S.SALARY_EDGES, [0, 1, 2, 3])),
    "k06_remote_level": ("remote_level_encoded", ["remote"], sql_cut("remote", S.REMOTE_EDGES, [0, 1, 2, 3])),
    "k07_growth_category": ("growth_category_encoded", _GROWTH_INPUTS, sql_cut(GROWTH_SQL, S.GROWTH_EDGES, [0, 1, 2, 3, 4])),
}


CODES_SQL = {column: sql for column, _, sql in _ORDERS.values()}


def _register_code(name, column, inputs, sql) -> None:
    def build(spark, sf_dir):
        rows = jobs(spark, sf_dir, "row_id", *inputs)
        return rows.select("row_id", F.coalesce(C.codes()[column], F.lit(-1)).alias(column))

    register(name, over_jobs(f"SELECT row_id, coalesce({sql}, -1) AS {column} FROM jobs"))(build)


for _name, _spec in _ORDERS.items():
    _register_code(_name, *_spec)


@register(
    "k01_education_strict",
    over_jobs(
        """SELECT row_id, CASE education WHEN 'High School' THEN 0 WHEN 'Associate Degree' THEN 1 WHEN 'PhD' THEN 4
           ELSE -1 END AS education_encoded FROM jobs"""
    ),
)
def education_strict(spark, sf_dir):
    code = F.coalesce(C.education_code("education", "strict"), F.lit(-1))
    return jobs(spark, sf_dir, "row_id", "education").select("row_id", code.alias("education_encoded"))


@register(
    "k08_item_labels",
    over_jobs(
        f"""SELECT row_id, {sql_lookup('job_status', S.GROWTH_ITEMS)} AS growth_trend,
            {sql_lookup('ai_impact', S.IMPACT_ITEMS)} AS ai_item FROM jobs"""
    ),
)
def item_labels(spark, sf_dir):
    return jobs(spark, sf_dir, "row_id", "job_status", "ai_impact").select(
        "row_id",
        C.lookup("job_status", S.GROWTH_ITEMS).alias("growth_trend"),
        C.lookup("ai_impact", S.IMPACT_ITEMS).alias("ai_item"),
    )
