"""Distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrove.catalog.registry import (
    GROWTH_SQL,
    RISK_SQL,
    over_jobs,
    r,
    register,
    rounded,
    settled,
    sql_cut,
    sql_levels,
    sql_long,
)
from riskgrove.functions.binning import cut
from riskgrove.functions.columns import growth_rate
from riskgrove.operators import distributions as D
from riskgrove.sources import schema as S
from riskgrove.sources.tables import jobs


def _histogram_sql(column: str, bins: int, density: bool) -> str:
    last = bins - 1
    extra = f", {r('coalesce(n, 0) / (total * w)', 9)} AS density" if density else ""
    return over_jobs(
        f""", x AS (SELECT CAST({column} AS DOUBLE) AS x FROM jobs),
        e AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS total, (max(x) - min(x)) / {bins} AS w FROM x),
        b AS (SELECT x, lo, w, least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS INT), {last}) AS b FROM x, e),
        s AS (SELECT CASE WHEN x < lo + b * w THEN b - 1
                          WHEN b < {last} AND x >= lo + (b + 1) * w THEN b + 1 ELSE b END AS bin FROM b),
        c AS (SELECT bin, count(*) AS n FROM s GROUP BY bin)
        SELECT g.bin, {r('lo + g.bin * w')} AS lower,
               {r(f'CASE WHEN g.bin = {last} THEN hi ELSE lo + (g.bin + 1) * w END')} AS upper,
               coalesce(n, 0) AS n{extra}
        FROM (SELECT CAST(range AS INT) AS bin FROM range({bins})) g CROSS JOIN e LEFT JOIN c ON c.bin = g.bin"""
    )


@register("d01_histogram_density", _histogram_sql("risk", 50, True))
def histogram_density(spark, sf_dir):
    out = D.histogram(jobs(spark, sf_dir, "risk"), "risk", 50, density=True)
    return out.select(
        "bin",
        settled("lower", 6).alias("lower"),
        settled("upper", 6).alias("upper"),
        "n",
        settled("density", 9).alias("density"),
    )


@register("d01_histogram_counts", _histogram_sql("salary", 40, False))
def histogram_counts(spark, sf_dir):
    return rounded(D.histogram(jobs(spark, sf_dir, "salary"), "salary", 40))


@register(
    "d02_centre_lines",
    over_jobs(
        f""", long AS ({sql_long(S.NUMERIC_WITH_TARGET)})
        SELECT "column", {r('avg(value)')} AS mean, {r('median(value)')} AS median
        FROM long GROUP BY "column" """
    ),
)
def centre_lines(spark, sf_dir):
    return rounded(D.centre_lines(jobs(spark, sf_dir, *S.NUMERIC_WITH_TARGET, heavy=True), S.NUMERIC_WITH_TARGET))


@register(
    "d03_kde",
    over_jobs(
        f""", e AS (SELECT min(risk) AS lo, max(risk) AS hi, stddev_samp(risk) * pow(count(risk), -0.2e0) AS h,
                    count(risk) AS n FROM jobs),
        c AS (SELECT risk AS x, count(*) AS ties FROM jobs GROUP BY risk),
        g AS (SELECT CAST(range AS INT) AS point,
                     lo - 0.5e0 * (hi - lo) + range * (2e0 * (hi - lo) / 999) AS x, h, n
              FROM range(1000), e)
        SELECT point, {r('g.x')} AS x,
               {r('sum(ties * exp(-0.5e0 * pow((g.x - c.x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 9)} AS density
        FROM g, c GROUP BY point, g.x"""
    ),
)
def kde(spark, sf_dir):
    out = D.kde(jobs(spark, sf_dir, "risk", heavy=True), "risk")
    return out.select("point", settled("x", 6).alias("x"), settled("density", 9).alias("density"))


def _side(rows):
    """Rows above 80 and below 20 as two tagged groups, stacked without a join."""
    side = F.when(F.col("risk") > 80, "High Risk").when(F.col("risk") < 20, "Low Risk")
    return rows.withColumn("side", side).where(F.col("side").isNotNull())


_SIDE_SQL = "CASE WHEN risk > 80 THEN 'High Risk' WHEN risk < 20 THEN 'Low Risk' END"


@register(
    "d04_kde_high_low",
    over_jobs(
        f""", sided AS (SELECT *, {_SIDE_SQL} AS side FROM jobs),
        long AS (SELECT * FROM ({sql_long(S.COMPARED, 'side', 'sided')}) WHERE side IS NOT NULL),
        c AS (SELECT side, "column", value, count(*) AS ties FROM long GROUP BY ALL),
        e AS (SELECT side, "column", min(value) AS vmin, max(value) AS vmax, count(*) AS n,
                     stddev_samp(value) * pow(count(*), -0.2e0) AS h FROM long GROUP BY ALL),
        t AS (SELECT *, sum(n) OVER (PARTITION BY "column") * 1e0 AS n_all FROM e),
        g AS (SELECT side, "column", CAST(range AS INT) AS point, h, n_all,
                     (vmin - 3 * h) + range * ((vmax + 3 * h - (vmin - 3 * h)) / 199) AS x
              FROM range(200), t)
        SELECT side, "column", point, {r('x')} AS x,
               {r('sum(ties * exp(-0.5e0 * pow((x - value) / h, 2))) / (any_value(n_all) * any_value(h) * sqrt(2 * pi()))', 9)} AS density
        FROM g JOIN c USING (side, "column") GROUP BY side, "column", point, x"""
    ),
)
def kde_high_low(spark, sf_dir):
    rows = _side(jobs(spark, sf_dir, "risk", *S.COMPARED, heavy=True))
    out = D.kde_groups(rows, S.COMPARED, "side")
    return out.select(
        "side", "column", "point", settled("x", 6).alias("x"), settled("density", 9).alias("density")
    )


@register(
    "d05_ecdf",
    over_jobs(
        f""", c AS (SELECT risk, count(*) AS ties FROM jobs GROUP BY risk)
        SELECT risk, ties, {r('sum(ties) OVER (ORDER BY risk) * 1e0 / sum(ties) OVER ()', 9)} AS fraction FROM c"""
    ),
)
def ecdf(spark, sf_dir):
    return D.ecdf(jobs(spark, sf_dir, "risk"), "risk").withColumn("fraction", settled("fraction", 9))


def box_sql(long: str, keys: str) -> str:
    """Box statistics of a (keys, value) relation."""
    return f""", long AS ({long}),
    q AS (SELECT {keys}, quantile_cont(value, 0.25) AS q1, median(value) AS median,
                 quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL),
    f AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM q)
    SELECT {keys}, count(*) AS n, {r('any_value(q1)')} AS q1, {r('any_value(median)')} AS median,
           {r('any_value(q3)')} AS q3,
           {r('least(min(CASE WHEN value >= lower AND value <= upper THEN value END), any_value(q1))')} AS whisker_low,
           {r('greatest(max(CASE WHEN value >= lower AND value <= upper THEN value END), any_value(q3))')} AS whisker_high,
           count(CASE WHEN value < lower OR value > upper THEN 1 END) AS fliers
    FROM long JOIN f USING ({keys}) GROUP BY {keys}"""


@register("d06_box_columns", over_jobs(box_sql(sql_long(S.NUMERIC), '"column"')))
def box_columns(spark, sf_dir):
    return rounded(D.box_stats(jobs(spark, sf_dir, *S.NUMERIC, heavy=True), S.NUMERIC))


@register(
    "d07_box_by_category",
    over_jobs(
        box_sql(
            " UNION ALL ".join(
                f"SELECT '{c}' AS dimension, {c} AS level, risk AS value FROM jobs" for c in S.CATEGORICAL
            ),
            "dimension, level",
        )
    ),
)
def box_by_category(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", *S.CATEGORICAL, heavy=True)
    return rounded(D.box_stats_by_category(rows, "risk", S.CATEGORICAL))


_GROWTH_LABEL = sql_cut(GROWTH_SQL, S.GROWTH_EDGES, S.GROWTH_LABELS)


@register(
    "d08_box_by_growth",
    over_jobs(box_sql(f"SELECT {_GROWTH_LABEL} AS growth, risk AS value FROM jobs", "growth")),
)
def box_by_growth(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", "openings_now", "openings_future").select(
        "risk", cut(growth_rate(), S.GROWTH_EDGES, S.GROWTH_LABELS).alias("growth")
    )
    return rounded(D.box_stats(rows, ["risk"], ["growth"]).drop("column"))


@register(
    "d09_box_by_cluster",
    over_jobs(box_sql("SELECT experience % 4 AS cluster, risk AS value FROM jobs", "cluster")),
)
def box_by_cluster(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", "experience").select(
        "risk", (F.col("experience") % 4).alias("cluster")
    )
    return rounded(D.box_stats(rows, ["risk"], ["cluster"]).drop("column"))


@register("d10_value_counts", over_jobs("SELECT industry, count(*) AS n FROM jobs GROUP BY industry"))
def value_counts(spark, sf_dir):
    return D.value_counts(jobs(spark, sf_dir, "industry"), "industry")


_LEVEL_COUNTS = """SELECT lv.level, lv.rank, count(x.level) AS n,
    round_even(count(x.level) * 100e0 / (SELECT count(*) FROM x), 2) AS pct
    FROM {levels} LEFT JOIN x ON x.level = lv.level GROUP BY lv.level, lv.rank"""


@register(
    "d11_risk_levels",
    over_jobs(
        f", x AS (SELECT {RISK_SQL} AS level FROM jobs) "
        + _LEVEL_COUNTS.format(levels=sql_levels(S.RISK_NAMES))
    ),
)
def risk_levels(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk").select(cut("risk", S.RISK_EDGES, S.RISK_NAMES).alias("level"))
    return D.level_counts(rows, "level", S.RISK_NAMES)


@register(
    "d11_growth_levels",
    over_jobs(
        f", x AS (SELECT {_GROWTH_LABEL} AS level FROM jobs) "
        + _LEVEL_COUNTS.format(levels=sql_levels([*S.GROWTH_LABELS, "unused level"]))
    ),
)
def growth_levels(spark, sf_dir):
    rows = jobs(spark, sf_dir, "openings_now", "openings_future").select(
        cut(growth_rate(), S.GROWTH_EDGES, S.GROWTH_LABELS).alias("level")
    )
    return D.level_counts(rows, "level", [*S.GROWTH_LABELS, "unused level"])


@register(
    "d12_shares",
    over_jobs(
        f"SELECT ai_impact, {r('count(*) * 1e0 / (SELECT count(*) FROM jobs)')} AS share FROM jobs GROUP BY ai_impact"
    ),
)
def shares(spark, sf_dir):
    return rounded(D.shares(jobs(spark, sf_dir, "ai_impact"), "ai_impact"))
