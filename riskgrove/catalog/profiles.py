"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrove.catalog.registry import (
    RISK_CODE_SQL,
    over_jobs,
    r,
    register,
    rounded,
    sql_long,
    sql_text,
)
from riskgrove.functions.binning import cut
from riskgrove.operators import profile as P, split as V
from riskgrove.sources import schema as S
from riskgrove.sources.tables import JOBS_COLUMNS, jobs

_STRINGS = ["row_id", "job_title", *S.CATEGORICAL]
_INTS = ["experience", "openings_now", "openings_future"]


def _dtype(name: str) -> str:
    return "string" if name in _STRINGS else "int" if name in _INTS else "double"


@register("p01_shape", over_jobs("SELECT count(*) AS n_rows, 14 AS n_columns FROM jobs"))
def shape(spark, sf_dir):
    return P.shape(jobs(spark, sf_dir))


@register(
    "p02_column_info",
    over_jobs(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{_dtype(c)}' AS dtype, count({c}) AS non_null FROM jobs"
            for c in JOBS_COLUMNS
        )
    ),
)
def column_info(spark, sf_dir):
    return P.column_info(jobs(spark, sf_dir))


@register(
    "p03_preview",
    over_jobs("SELECT row_id, job_title, industry, salary, risk FROM jobs ORDER BY row_id LIMIT 5"),
)
def preview(spark, sf_dir):
    return P.preview(jobs(spark, sf_dir, "row_id", "job_title", "industry", "salary", "risk"), ["row_id"])


# The risk levels and the diversity bins leave some rows without a label.
_LEVELED = f", leveled AS (SELECT {', '.join(JOBS_COLUMNS)}, CASE WHEN diversity > 0 AND diversity <= 35 THEN 'low' END AS low_diversity FROM jobs) "


@register(
    "p04_missing_report",
    over_jobs(
        _LEVELED
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
            f"round_even((count(*) - count({c})) * 100e0 / count(*), 2) AS missing_pct FROM leveled"
            for c in (*JOBS_COLUMNS, "low_diversity")
        )
    ),
)
def missing_report(spark, sf_dir):
    rows = jobs(spark, sf_dir, *JOBS_COLUMNS).withColumn(
        "low_diversity", cut("diversity", [0, 35], ["low"])
    )
    return P.missing_report(rows)


def _describe_sql(cols: list[str], digits: int) -> str:
    e = lambda x: f"round_even({x}, {digits}) + 0e0"
    return over_jobs(
        f""", long AS ({sql_long(cols)})
        SELECT "column", count(value) AS count, {e('avg(value)')} AS mean,
               {e('stddev_samp(value)')} AS std, {e('min(value)')} AS min,
               {e('quantile_cont(value, 0.25)')} AS q25, {e('quantile_cont(value, 0.5)')} AS q50,
               {e('quantile_cont(value, 0.75)')} AS q75, {e('max(value)')} AS max
        FROM long GROUP BY "column" """
    )


@register("p05_describe_numeric", _describe_sql(S.NUMERIC_WITH_TARGET, 2))
def describe_numeric(spark, sf_dir):
    return P.describe_numeric(
        jobs(spark, sf_dir, *S.NUMERIC_WITH_TARGET, heavy=True), S.NUMERIC_WITH_TARGET, digits=2
    )


@register(
    "p06_describe_categorical",
    over_jobs(
        f""", long AS ({sql_long(["job_title", *S.CATEGORICAL], cast="VARCHAR")}),
        counts AS (SELECT "column", value, count(*) AS n FROM long GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn
                   FROM counts)
        SELECT "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
               max(CASE WHEN rn = 1 THEN value END) AS top,
               max(CASE WHEN rn = 1 THEN n END) AS freq
        FROM ranked GROUP BY "column" """
    ),
)
def describe_categorical(spark, sf_dir):
    cols = ["job_title", *S.CATEGORICAL]
    return P.describe_categorical(jobs(spark, sf_dir, *cols), cols)


@register(
    "p07_duplicates",
    over_jobs(
        f""", copies AS (SELECT {', '.join(JOBS_COLUMNS)}, count(*) AS n FROM jobs GROUP BY ALL)
        SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicates,
               round_even((sum(n) - count(*)) * 100e0 / sum(n), 2) AS duplicate_pct FROM copies"""
    ),
)
def duplicates(spark, sf_dir):
    return P.duplicates(jobs(spark, sf_dir, *JOBS_COLUMNS))


@register("p08_describe_target", _describe_sql([S.TARGET], 4))
def describe_target(spark, sf_dir):
    return P.describe_numeric(jobs(spark, sf_dir, S.TARGET), [S.TARGET], digits=4)


@register("p09_skewness", over_jobs(f"SELECT {r('skewness(risk)')} AS skewness FROM jobs"))
def skewness(spark, sf_dir):
    return rounded(jobs(spark, sf_dir, "risk").agg(P.skewness(F.col("risk")).alias("skewness")))


@register("p10_kurtosis", over_jobs(f"SELECT {r('kurtosis(risk)')} AS kurtosis FROM jobs"))
def kurtosis(spark, sf_dir):
    return rounded(jobs(spark, sf_dir, "risk").agg(P.excess_kurtosis(F.col("risk")).alias("kurtosis")))


@register(
    "p11_distinct_counts",
    over_jobs(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM jobs"
            for c in ["job_title", *S.CATEGORICAL]
        )
    ),
)
def distinct_counts(spark, sf_dir):
    cols = ["job_title", *S.CATEGORICAL]
    return P.distinct_counts(jobs(spark, sf_dir, *cols), cols)


@register("p12_target_range", over_jobs("SELECT min(risk) AS min, max(risk) AS max FROM jobs"))
def target_range(spark, sf_dir):
    return P.value_range(jobs(spark, sf_dir, "risk"), "risk")


def split_sql(label: str, share: float = 0.2, seed: int = 42) -> str:
    """CTE ``split_rows``: the analysis rows with label and split."""
    return f""", labelled AS (SELECT *, {label} AS label FROM jobs),
    placed AS (SELECT *, row_number() OVER (PARTITION BY label
                   ORDER BY md5(concat(row_id, '-{seed}')), row_id) AS place,
               count(*) OVER (PARTITION BY label) AS size FROM labelled),
    split_rows AS (SELECT *, CASE WHEN place <= round(size * {share}e0) THEN 'test' ELSE 'train' END AS split
                   FROM placed) """


def split_jobs(spark, sf_dir, *cols):
    """The asked columns with the risk class as label, and the stratified split."""
    names = list(dict.fromkeys(["row_id", "risk", *cols]))
    rows = jobs(spark, sf_dir, *names).withColumn("label", cut("risk", S.RISK_EDGES, S.RISK_CODES))
    return V.stratified_split(rows, "label", "row_id")


@register(
    "p13_split_quality",
    over_jobs(
        split_sql(RISK_CODE_SQL)
        + """, checked AS (SELECT split, CASE WHEN diversity > 0 THEN salary / diversity END AS per_point,
              CASE WHEN remote = 0 THEN CAST('inf' AS DOUBLE) ELSE salary / remote END AS per_remote
              FROM split_rows)
        SELECT split, count(*) AS n_rows, count(*) - count(per_point) AS n_missing,
               count(CASE WHEN per_remote = CAST('inf' AS DOUBLE) THEN 1 END) AS n_infinite
        FROM checked GROUP BY split"""
    ),
)
def split_quality(spark, sf_dir):
    rows = split_jobs(spark, sf_dir, "salary", "remote", "diversity")
    inf = F.lit(float("inf"))
    return P.quality(
        rows.select(
            "split",
            F.try_divide("salary", "diversity").alias("per_point"),
            F.coalesce(F.try_divide("salary", "remote"), inf).alias("per_remote"),
        ),
        "split",
    )


@register(
    "p14_class_counts",
    over_jobs(
        f""", labelled AS (SELECT {RISK_CODE_SQL} AS label FROM jobs)
        SELECT {', '.join(f'count(CASE WHEN label = {k} THEN 1 END) AS n_{k}' for k in S.RISK_CODES)}
        FROM labelled"""
    ),
)
def class_counts(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk").select(cut("risk", S.RISK_EDGES, S.RISK_CODES).alias("label"))
    return P.class_counts(rows, "label", S.RISK_CODES)


@register(
    "p15_split_sizes",
    over_jobs(
        split_sql(RISK_CODE_SQL)
        + """SELECT split, count(*) AS n,
             round_even(count(*) * 100e0 / (SELECT count(*) FROM split_rows), 1) AS pct
             FROM split_rows GROUP BY split"""
    ),
)
def split_sizes(spark, sf_dir):
    return P.group_shares(split_jobs(spark, sf_dir), "split")
