"""Correlation and test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrove.catalog.registry import GROWTH_SQL, over_jobs, r, register, rounded, sql_long
from riskgrove.functions.columns import growth_rate
from riskgrove.operators import ranks as O, stats as T
from riskgrove.sources import schema as S
from riskgrove.sources.tables import jobs

_ALL = S.NUMERIC_WITH_TARGET


def _rank_cte(cols: list[str], source: str = "jobs") -> str:
    return (
        ", ranked AS (SELECT "
        + ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}"
            for c in cols
        )
        + f" FROM {source}) "
    )


def _pairs_sql(source: str, cols: list[str], lower: bool) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM {source}"
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
        if not lower or j < i
    )


def _target_sql(source: str) -> str:
    return f""", c AS (SELECT * FROM ({_pairs_sql(source, _ALL, False)}) WHERE b = 'risk' AND a <> 'risk')
        SELECT a AS feature, r, CASE WHEN abs(r) > 0.3e0 THEN '***' WHEN abs(r) > 0.2e0 THEN '**'
               WHEN abs(r) > 0.1e0 THEN '*' ELSE '' END AS strength FROM c"""


def _numbers(spark, sf_dir):
    return jobs(spark, sf_dir, *_ALL, heavy=True)


@register("s01_pearson_matrix", over_jobs(_pairs_sql("jobs", _ALL, False)))
def pearson_matrix(spark, sf_dir):
    return rounded(T.pearson_matrix(_numbers(spark, sf_dir), _ALL))


@register("s01_pearson_lower", over_jobs(_pairs_sql("jobs", _ALL, True)))
def pearson_lower(spark, sf_dir):
    return rounded(T.pearson_matrix(_numbers(spark, sf_dir), _ALL, lower=True))


@register("s02_spearman_matrix", over_jobs(_rank_cte(_ALL) + _pairs_sql("ranked", _ALL, False)))
def spearman_matrix(spark, sf_dir):
    return rounded(T.spearman_matrix(_numbers(spark, sf_dir), _ALL))


@register("s03_target_pearson", over_jobs(_target_sql("jobs")))
def target_pearson(spark, sf_dir):
    return rounded(T.target_correlations(T.pearson_matrix(_numbers(spark, sf_dir), _ALL), S.TARGET))


@register("s03_target_spearman", over_jobs(_rank_cte(_ALL) + _target_sql("ranked")))
def target_spearman(spark, sf_dir):
    return rounded(T.target_correlations(T.spearman_matrix(_numbers(spark, sf_dir), _ALL), S.TARGET))


def _growth(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", "openings_now", "openings_future")
    return rows.select(growth_rate().alias("growth"), "risk")


_GROWTH_CTE = f", g AS (SELECT {GROWTH_SQL} AS growth, risk FROM jobs)"


@register("s04_pearson_pair", over_jobs(_GROWTH_CTE + f" SELECT {r('corr(growth, risk)')} AS r FROM g"))
def pearson_pair(spark, sf_dir):
    return rounded(_growth(spark, sf_dir).agg(T.pearson(F.col("growth"), F.col("risk")).alias("r")))


@register(
    "s05_spearman_pair",
    over_jobs(_GROWTH_CTE + _rank_cte(["growth", "risk"], "g") + f"SELECT {r('corr(growth, risk)')} AS r FROM ranked"),
)
def spearman_pair(spark, sf_dir):
    ranks = T.with_ranks(_growth(spark, sf_dir), ["growth", "risk"])
    return rounded(ranks.agg(T.pearson(F.col("growth"), F.col("risk")).alias("r")))


# The upper tail of chi-square by Simpson's rule, as the engine has no such function.
_KRUSKAL = (
    _rank_cte(["risk", *S.CATEGORICAL]).replace(
        ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}"
            for c in S.CATEGORICAL
        ),
        ", ".join(S.CATEGORICAL),
    )
    + f""", long AS ({" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS level, risk AS rk FROM ranked" for c in S.CATEGORICAL)}),
    g AS (SELECT dimension, level, sum(rk) AS rs, count(*) AS m FROM long GROUP BY ALL),
    t AS (SELECT sum(pow(ties, 3) - ties) AS tie, sum(ties) * 1e0 AS n
          FROM (SELECT count(*) * 1e0 AS ties FROM jobs GROUP BY risk)),
    h AS (SELECT dimension, count(*) AS groups,
                 (12e0 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / m) - 3 * (any_value(n) + 1))
                 / (1 - any_value(tie) / (pow(any_value(n), 3) - any_value(n))) AS h
          FROM g, t GROUP BY dimension)
    """
)


@register("s06_kruskal_h", over_jobs(_KRUSKAL + f"SELECT dimension, groups, {r('h')} AS h FROM h"))
def kruskal_h(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", *S.CATEGORICAL, heavy=True)
    return rounded(T.kruskal(rows, "risk", S.CATEGORICAL))


@register(
    "s06_kruskal_test",
    over_jobs(
        _KRUSKAL
        + f""", x AS (SELECT dimension, h, groups - 1 AS k, h + range * 0.01e0 AS x,
                 CASE WHEN range = 0 OR range = 20000 THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w
                 FROM h, range(20001)),
        p AS (SELECT dimension, sum(w * pow(x, k / 2e0 - 1) * exp(-x / 2)) * 0.01e0 / 3
                     / (pow(2e0, any_value(k) / 2e0) * gamma(any_value(k) / 2e0)) AS p FROM x GROUP BY dimension)
        SELECT dimension, groups, {r('h')} AS h, {r('p')} AS p,
               CASE WHEN p < 0.001e0 THEN '***' WHEN p < 0.01e0 THEN '**' WHEN p < 0.05e0 THEN '*' ELSE 'n.s.' END AS mark
        FROM h JOIN p USING (dimension)"""
    ),
)
def kruskal_test(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", *S.CATEGORICAL, heavy=True)
    return rounded(T.kruskal_test(rows, "risk", S.CATEGORICAL))


@register(
    "s07_mann_whitney",
    over_jobs(
        f""", two AS (SELECT risk, job_status, rank() OVER (ORDER BY risk)
                      + (count(*) OVER (PARTITION BY risk) - 1) / 2e0 AS rk FROM jobs),
        s AS (SELECT sum(rk) FILTER (job_status = 'Increasing') AS r1,
                     count(*) FILTER (job_status = 'Increasing') * 1e0 AS n1,
                     count(*) FILTER (job_status = 'Decreasing') * 1e0 AS n2, count(*) * 1e0 AS n,
                     avg(risk) FILTER (job_status = 'Increasing') AS mean_first,
                     avg(risk) FILTER (job_status = 'Decreasing') AS mean_second,
                     median(risk) FILTER (job_status = 'Increasing') AS median_first,
                     median(risk) FILTER (job_status = 'Decreasing') AS median_second FROM two),
        t AS (SELECT sum(pow(ties, 3) - ties) AS tie FROM (SELECT count(*) * 1e0 AS ties FROM two GROUP BY risk)),
        u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s, t),
        z AS (SELECT *, greatest((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5e0)
                     / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))), 0e0) AS z FROM u),
        p AS (SELECT sum((CASE WHEN range = 0 OR range = 20000 THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END)
                     * exp(-pow(z + range * 0.001e0, 2) / 2)) * 0.001e0 / 3 * sqrt(2 / pi()) AS p FROM z, range(20001))
        SELECT {r('u', 1)} AS u, {r('z')} AS z, {r('mean_first')} AS mean_first, {r('mean_second')} AS mean_second,
               {r('median_first')} AS median_first, {r('median_second')} AS median_second,
               {r('p')} AS p, p < 0.05e0 AS significant FROM z, p"""
    ),
)
def mann_whitney(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", "job_status")
    return rounded(T.mann_whitney(rows, "risk", "job_status", "Increasing", "Decreasing"))


@register(
    "s08_least_squares",
    over_jobs(
        _GROWTH_CTE
        + f" SELECT {r('regr_slope(risk, growth)')} AS slope, {r('regr_intercept(risk, growth)')} AS intercept FROM g"
    ),
)
def least_squares(spark, sf_dir):
    return rounded(T.least_squares(_growth(spark, sf_dir), "growth", "risk"))


@register(
    "s08_fitted_line",
    over_jobs(
        _GROWTH_CTE
        + f""", f AS (SELECT regr_slope(risk, growth) AS b, regr_intercept(risk, growth) AS a,
                    min(growth) AS lo, max(growth) AS hi FROM g),
        p AS (SELECT CAST(range AS INT) AS point, a, b, lo + range * (hi - lo) / 99 AS x FROM f, range(100))
        SELECT point, {r('x')} AS x, {r('b * x + a')} AS y FROM p"""
    ),
)
def fitted_line(spark, sf_dir):
    return rounded(T.fitted_line(_growth(spark, sf_dir), "growth", "risk"))


@register(
    "s09_scatter",
    over_jobs(f"SELECT row_id, {r(GROWTH_SQL)} AS growth, {r('risk')} AS risk FROM jobs"),
)
def scatter(spark, sf_dir):
    rows = jobs(spark, sf_dir, "row_id", "risk", "openings_now", "openings_future")
    return rounded(rows.select("row_id", growth_rate().alias("growth"), "risk"))


@register(
    "s09_scatter_bins",
    over_jobs(
        _GROWTH_CTE
        + """ SELECT CAST(floor(growth / 0.5e0) AS BIGINT) AS x_cell, CAST(floor(risk / 5e0) AS BIGINT) AS y_cell,
              count(*) AS n FROM g GROUP BY ALL"""
    ),
)
def scatter_bins(spark, sf_dir):
    return T.scatter_bins(_growth(spark, sf_dir), "growth", "risk", 0.5, 5.0)


@register(
    "o01_average_ranks",
    over_jobs(
        """, x AS (SELECT risk, rank() OVER (ORDER BY risk) AS first FROM jobs)
        SELECT risk, count(*) AS ties, min(first) + (count(*) - 1) / 2e0 AS avg_rank,
               (SELECT count(*) FROM jobs) AS n FROM x GROUP BY risk"""
    ),
)
def average_ranks(spark, sf_dir):
    return O.average_ranks(jobs(spark, sf_dir, "risk"), "risk")


@register(
    "o01_average_ranks_by_column",
    over_jobs(
        f""", long AS ({sql_long(S.NUMERIC)}),
        x AS (SELECT "column", value, rank() OVER (PARTITION BY "column" ORDER BY value) AS first FROM long)
        SELECT "column", value, count(*) AS ties, min(first) + (count(*) - 1) / 2e0 AS avg_rank,
               (SELECT count(*) FROM jobs) AS n FROM x GROUP BY "column", value"""
    ),
)
def average_ranks_by_column(spark, sf_dir):
    long = O.long_form(jobs(spark, sf_dir, *S.NUMERIC, heavy=True), S.NUMERIC)
    return O.average_ranks(long, "value", ["column"])
