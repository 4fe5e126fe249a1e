"""Selection, join, cross-tab, top-list and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrove.catalog.registry import (
    GROWTH_SQL,
    RISK_CODE_SQL,
    RISK_SQL,
    over_jobs,
    r,
    register,
    rounded,
    settled,
    sql_cut,
    sql_levels,
    sql_lookup,
    sql_long,
    sql_text,
)
from riskgrove.functions.binning import cut
from riskgrove.functions.columns import growth_rate
from riskgrove.operators import crosstab as A, select as Q
from riskgrove.operators.common import one_row
from riskgrove.operators.evaluate import argmax
from riskgrove.sources import schema as S
from riskgrove.sources.tables import jobs

# Deterministic scores that stand in for a model's output: label, class scores, prediction.
SCORED_SQL = f"""scores AS (SELECT *, {RISK_CODE_SQL} AS label, salary / 150000 AS p2,
        (1 - salary / 150000) * remote / 100 AS p1 FROM jobs),
    scored0 AS (SELECT *, greatest(1 - p2 - p1, 0e0) AS p0 FROM scores),
    scored AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction
               FROM scored0)"""


def scored(spark, sf_dir, *cols: str, heavy: bool = False):
    """The asked columns with label, p0, p1, p2 and prediction."""
    names = list(dict.fromkeys(["risk", "salary", "remote", *cols]))
    p2 = F.col("salary") / 150000
    rows = jobs(spark, sf_dir, *names, heavy=heavy).select(
        *[F.col(c) for c in cols],
        cut("risk", S.RISK_EDGES, S.RISK_CODES).alias("label"),
        p2.alias("p2"),
        ((1 - p2) * F.col("remote") / 100).alias("p1"),
    )
    rows = rows.withColumn("p0", F.greatest(1 - F.col("p2") - F.col("p1"), F.lit(0.0)))
    return rows.withColumn("prediction", argmax([F.col("p0"), F.col("p1"), F.col("p2")]))


# --- filters ---


@register(
    "f01_extremes",
    over_jobs(
        """, c AS (SELECT count(*) AS total, count(CASE WHEN risk > 80 THEN 1 END) AS h,
                   count(CASE WHEN risk < 20 THEN 1 END) AS l FROM jobs)
        SELECT 'high' AS subset, h AS n, round_even(h * 100e0 / total, 1) AS pct FROM c
        UNION ALL SELECT 'low', l, round_even(l * 100e0 / total, 1) FROM c"""
    ),
)
def extremes(spark, sf_dir):
    return Q.extremes(jobs(spark, sf_dir, "risk"), "risk")


@register("f02_status_split", over_jobs("SELECT row_id, risk FROM jobs WHERE job_status = 'Increasing'"))
def status_split(spark, sf_dir):
    rows = jobs(spark, sf_dir, "row_id", "risk", "job_status")
    return rows.where(F.col("job_status") == "Increasing").select("row_id", "risk")


@register(
    "f03_iqr_outliers",
    over_jobs(
        f""", long AS ({sql_long(S.NUMERIC_WITH_TARGET)} UNION ALL SELECT 'growth', {GROWTH_SQL} FROM jobs),
        q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
              FROM long GROUP BY ALL),
        b AS (SELECT "column", q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM q)
        SELECT "column", {r('any_value(lower)')} AS lower, {r('any_value(upper)')} AS upper,
               count(CASE WHEN value < lower OR value > upper THEN 1 END) AS n_outliers,
               round_even(count(CASE WHEN value < lower OR value > upper THEN 1 END) * 100e0 / count(*), 2) AS pct
        FROM long JOIN b USING ("column") GROUP BY "column" """
    ),
)
def iqr_outliers(spark, sf_dir):
    rows = jobs(spark, sf_dir, *S.NUMERIC_WITH_TARGET, heavy=True).withColumn("growth", growth_rate())
    return rounded(Q.iqr_outliers(rows, [*S.NUMERIC_WITH_TARGET, "growth"]))


@register(
    "f04_predicted_class",
    over_jobs(f", {SCORED_SQL} SELECT row_id, prediction, {r('p2')} AS p2 FROM scored WHERE prediction = 2"),
)
def predicted_class(spark, sf_dir):
    rows = scored(spark, sf_dir, "row_id").where(F.col("prediction") == 2)
    return rounded(rows.select("row_id", "prediction", "p2"))


@register(
    "f05_cluster_rows",
    over_jobs("SELECT row_id, experience % 4 AS cluster, risk FROM jobs WHERE experience % 4 = 3"),
)
def cluster_rows(spark, sf_dir):
    rows = jobs(spark, sf_dir, "row_id", "experience", "risk")
    cluster = F.col("experience") % 4
    return rows.where(cluster == 3).select("row_id", cluster.alias("cluster"), "risk")


@register(
    "f10_first_match",
    over_jobs(
        f""", {SCORED_SQL}, hit AS (SELECT row_id, prediction, 0 AS o FROM scored WHERE prediction = 2
                                    ORDER BY row_id LIMIT 1),
        back AS (SELECT row_id, prediction, 1 AS o FROM scored ORDER BY row_id LIMIT 1)
        SELECT row_id, prediction FROM (SELECT * FROM hit UNION ALL SELECT * FROM back) ORDER BY o LIMIT 1"""
    ),
)
def first_match(spark, sf_dir):
    rows = scored(spark, sf_dir, "row_id").select("row_id", "prediction")
    return Q.first_match(rows, F.col("prediction") == 2, "row_id")


@register(
    "f10_first_match_fallback",
    over_jobs(
        f", {SCORED_SQL} SELECT row_id, prediction FROM scored ORDER BY row_id LIMIT 1 OFFSET 1"
    ),
)
def first_match_fallback(spark, sf_dir):
    rows = scored(spark, sf_dir, "row_id").select("row_id", "prediction")
    return Q.first_match(rows, F.col("prediction") == 9, "row_id", fallback=1)


_FIRST_FIVE = f""", {SCORED_SQL}, firsts AS (SELECT row_id, prediction, row_number() OVER
    (PARTITION BY prediction ORDER BY row_id) AS rn FROM scored WHERE prediction IN (0, 2))
    SELECT row_id, prediction FROM firsts WHERE rn <= 5"""


@register("f11_first_of_each", over_jobs(_FIRST_FIVE))
def first_of_each(spark, sf_dir):
    rows = scored(spark, sf_dir, "row_id").select("row_id", "prediction")
    return Q.first_of_each(rows, "prediction", [2, 0], "row_id", 5)


@register(
    "f12_head_sample",
    over_jobs("SELECT row_id, risk FROM jobs ORDER BY row_id LIMIT 2000"),
)
def head_sample(spark, sf_dir):
    return Q.head_sample(jobs(spark, sf_dir, "row_id", "risk"), "row_id", 2000)


_SAMPLE_SQL = "ORDER BY md5(concat(row_id, '-42')), row_id LIMIT 5000"


@register("f13_random_sample", over_jobs(f"SELECT row_id, risk FROM jobs {_SAMPLE_SQL}"))
def random_sample(spark, sf_dir):
    return Q.random_sample(jobs(spark, sf_dir, "row_id", "risk"), "row_id", 5000, seed=42)


# --- joins ---


@register(
    "j01_join_predictions",
    over_jobs(
        f", {SCORED_SQL} SELECT row_id, job_title, industry, {r('risk')} AS risk, prediction, {r('p2')} AS high_prob FROM scored"
    ),
)
def join_predictions(spark, sf_dir):
    raw = jobs(spark, sf_dir, "row_id", "job_title", "industry", "risk")
    found = scored(spark, sf_dir, "row_id").select("row_id", "prediction", F.col("p2").alias("high_prob"))
    return rounded(raw.join(found, "row_id"))


@register(
    "j02_join_clusters",
    over_jobs("SELECT row_id, industry, experience % 4 AS cluster, risk FROM jobs"),
)
def join_clusters(spark, sf_dir):
    raw = jobs(spark, sf_dir, "row_id", "industry")
    labels = jobs(spark, sf_dir, "row_id", "experience", "risk").select(
        "row_id", (F.col("experience") % 4).alias("cluster"), "risk"
    )
    return raw.join(labels, "row_id")


_KNOWN = {"High School": 0, "Associate Degree": 1, "PhD": 4}


@register(
    "j03_dictionary_join",
    over_jobs(f"SELECT row_id, education, coalesce({sql_lookup('education', _KNOWN)}, -1) AS code FROM jobs"),
)
def dictionary_join(spark, sf_dir):
    # A dictionary of a few literal entries: the broadcast is bounded by the program text.
    table = spark.createDataFrame(list(_KNOWN.items()), "education string, code int")
    rows = jobs(spark, sf_dir, "row_id", "education").join(F.broadcast(table), "education", "left")
    return rows.select("row_id", "education", F.coalesce("code", F.lit(-1)).alias("code"))


@register(
    "j05_feature_alignment",
    over_jobs(
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS feature, {r(f'avg({c})')} AS importance FROM jobs"
            for i, c in enumerate(S.NUMERIC)
        )
    ),
)
def feature_alignment(spark, sf_dir):
    rows = jobs(spark, sf_dir, *S.NUMERIC)
    scores = rows.agg(F.array(*[F.avg(c) for c in S.NUMERIC]).alias("v")).select(
        F.posexplode("v").alias("position", "importance")
    )
    names = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(c) for c in S.NUMERIC])).alias("position", "feature")
    )
    return rounded(names.join(scores, "position"))


@register(
    "j06_outer_align",
    over_jobs(
        """SELECT row_id, CASE WHEN risk > 80 THEN salary END AS high_risk, CASE WHEN risk < 20 THEN salary END
           AS low_risk FROM jobs WHERE risk > 80 OR risk < 20"""
    ),
)
def outer_align(spark, sf_dir):
    rows = jobs(spark, sf_dir, "row_id", "risk", "salary")
    high = rows.where(F.col("risk") > 80).select("row_id", F.col("salary").alias("high_risk"))
    low = rows.where(F.col("risk") < 20).select("row_id", F.col("salary").alias("low_risk"))
    return high.unionByName(low, allowMissingColumns=True)


@register(
    "j08_scalar_broadcast",
    over_jobs(
        f""", s AS (SELECT avg(risk) AS m, max(risk) AS hi FROM jobs)
        SELECT row_id, {r('risk - m')} AS off_mean, {r('risk / hi')} AS of_max FROM jobs, s"""
    ),
)
def scalar_broadcast(spark, sf_dir):
    rows = jobs(spark, sf_dir, "row_id", "risk")
    stats = one_row(rows, m=F.avg("risk"), hi=F.max("risk"))
    return rounded(
        rows.select(
            "row_id",
            (F.col("risk") - stats.getField("m")).alias("off_mean"),
            (F.col("risk") / stats.getField("hi")).alias("of_max"),
        )
    )


@register(
    "j09_keep_keys",
    over_jobs(
        f""", keys AS (SELECT row_id FROM jobs {_SAMPLE_SQL})
        SELECT row_id, industry, risk FROM jobs WHERE row_id IN (SELECT row_id FROM keys)"""
    ),
)
def keep_keys(spark, sf_dir):
    keys = Q.random_sample(jobs(spark, sf_dir, "row_id"), "row_id", 5000)
    return Q.keep_keys(jobs(spark, sf_dir, "row_id", "industry", "risk"), keys, "row_id")


# --- aggregates and cross-tabs ---


@register(
    "a01_group_medians",
    over_jobs(f"SELECT industry, {r('median(risk)')} AS median FROM jobs GROUP BY industry"),
)
def group_medians(spark, sf_dir):
    return rounded(A.group_medians(jobs(spark, sf_dir, "industry", "risk"), "risk", "industry"))


_GROWTH_LABEL = sql_cut(GROWTH_SQL, S.GROWTH_EDGES, S.GROWTH_LABELS)


@register(
    "a02_growth_means",
    over_jobs(
        f""", g AS (SELECT {_GROWTH_LABEL} AS level, risk FROM jobs)
        SELECT lv.level, lv.rank, round_even(avg(risk), 2) AS mean FROM {sql_levels(S.GROWTH_LABELS)}
        LEFT JOIN g ON g.level = lv.level GROUP BY ALL"""
    ),
)
def growth_means(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", "openings_now", "openings_future").select(
        "risk", cut(growth_rate(), S.GROWTH_EDGES, S.GROWTH_LABELS).alias("level")
    )
    return A.level_means(rows, "level", S.GROWTH_LABELS, "risk")


_CATEGORY_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c} AS level, lv FROM leveled" for c in S.CATEGORICAL
)

RISK_SHARES_SQL = over_jobs(
    f""", leveled AS (SELECT *, {RISK_SQL} AS lv FROM jobs), long AS ({_CATEGORY_LONG})
    SELECT dimension, level, {', '.join(
        r(f"count(CASE WHEN lv = {sql_text(x)} THEN 1 END) * 1e0 / count(*) * 100") + f' AS "{x}"'
        for x in S.RISK_NAMES)} FROM long GROUP BY dimension, level"""
)


@register("a03_risk_shares", RISK_SHARES_SQL)
def risk_shares(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", *S.CATEGORICAL).withColumn(
        "risk_level", cut("risk", S.RISK_EDGES, S.RISK_NAMES)
    )
    return rounded(A.row_shares(rows, S.CATEGORICAL, "risk_level", S.RISK_NAMES))


def _pivot_sql(index: str, column: str, levels: list[str]) -> str:
    cells = ", ".join(f"{r(f'avg(CASE WHEN {column} = {sql_text(x)} THEN risk END)')} AS \"{x}\"" for x in levels)
    return over_jobs(f"SELECT {index}, {cells} FROM jobs GROUP BY {index}")


@register("a04_industry_impact", _pivot_sql("industry", "ai_impact", S.IMPACT_ORDER))
def industry_impact(spark, sf_dir):
    rows = jobs(spark, sf_dir, "industry", "ai_impact", "risk")
    return rounded(A.pivot_mean(rows, "industry", "ai_impact", "risk", S.IMPACT_ORDER))


_ASCII_ORDER = [x.replace("’", "'") for x in S.EDUCATION_ORDER]


@register(
    "a05_education_status",
    over_jobs(
        f"""SELECT lv.education, {r("coalesce(avg(CASE WHEN job_status = 'Decreasing' THEN risk END), -1e0)")} AS "Decreasing",
            {r("coalesce(avg(CASE WHEN job_status = 'Increasing' THEN risk END), -1e0)")} AS "Increasing"
        FROM {sql_levels(_ASCII_ORDER, 'education')} LEFT JOIN jobs ON jobs.education = lv.education
        GROUP BY lv.education"""
    ),
)
def education_status(spark, sf_dir):
    """Re-indexed to the ASCII spelling as published: two levels do not occur in the data."""
    rows = jobs(spark, sf_dir, "education", "job_status", "risk")
    return rounded(
        A.pivot_mean(rows, "education", "job_status", "risk", S.STATUS_ORDER, _ASCII_ORDER).fillna(-1.0)
    )


@register(
    "a06_location_industry",
    over_jobs(f"SELECT location, industry, {r('avg(risk)')} AS mean FROM jobs GROUP BY ALL"),
)
def location_industry(spark, sf_dir):
    rows = jobs(spark, sf_dir, "location", "industry", "risk")
    wide = A.pivot_mean(rows, "location", "industry", "risk")
    long = wide.unpivot(["location"], [c for c in wide.columns if c != "location"], "industry", "mean")
    return rounded(long.where(F.col("mean").isNotNull()))


@register(
    "a07_high_low_means",
    over_jobs(
        f", long AS ({sql_long(S.COMPARED, 'risk')}), m AS (SELECT \"column\", avg(CASE WHEN risk > 80 THEN value END) AS h, "
        f"avg(CASE WHEN risk < 20 THEN value END) AS l FROM long GROUP BY \"column\") "
        f"SELECT \"column\", {r('h')} AS high_mean, {r('l')} AS low_mean, "
        f"{r('CASE WHEN l <> 0 THEN (h - l) / l * 100 ELSE 0e0 END')} AS diff_pct FROM m"
    ),
)
def high_low_means(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", *S.COMPARED)
    return rounded(A.compare_means(rows, S.COMPARED, F.col("risk") > 80, F.col("risk") < 20))


@register(
    "a15_scalars",
    over_jobs(
        f"""SELECT 'risk' AS "column", {r('avg(risk)')} AS mean, {r('stddev_samp(risk)')} AS std,
            {r('quantile_cont(risk, 0.25)')} AS q25, {r('median(risk)')} AS median,
            {r('quantile_cont(risk, 0.75)')} AS q75 FROM jobs"""
    ),
)
def scalars(spark, sf_dir):
    return rounded(A.scalars(jobs(spark, sf_dir, "risk"), "risk"))


# --- top lists ---


def _top_sql(where: str) -> str:
    return over_jobs(
        f"SELECT job_title, count(*) AS n FROM jobs WHERE {where} GROUP BY job_title ORDER BY n DESC, job_title LIMIT 15"
    )


@register("o02_top_titles_high", _top_sql("risk > 80"))
def top_titles_high(spark, sf_dir):
    rows = jobs(spark, sf_dir, "job_title", "risk")
    return Q.top_counts(rows.where(F.col("risk") > 80), "job_title")


@register("o02_top_titles_low", _top_sql("risk < 20"))
def top_titles_low(spark, sf_dir):
    rows = jobs(spark, sf_dir, "job_title", "risk")
    return Q.top_counts(rows.where(F.col("risk") < 20), "job_title")


@register(
    "o03_top_predicted",
    over_jobs(
        f""", {SCORED_SQL} SELECT row_id, job_title, {r('p2')} AS p2 FROM scored WHERE prediction = 2
            ORDER BY scored.p2 DESC, row_id LIMIT 20"""
    ),
)
def top_predicted(spark, sf_dir):
    rows = scored(spark, sf_dir, "row_id", "job_title").where(F.col("prediction") == 2)
    return rounded(Q.top_rows(rows.select("row_id", "job_title", "p2"), [F.desc("p2"), "row_id"], 20))


@register(
    "o04_top_importances",
    over_jobs(
        f", long AS ({sql_long(S.NUMERIC, 'risk')}) SELECT \"column\" AS feature, {r('abs(corr(value, risk))', 9)} AS importance "
        "FROM long GROUP BY ALL ORDER BY importance DESC, feature LIMIT 15"
    ),
)
def top_importances(spark, sf_dir):
    long = jobs(spark, sf_dir, "risk", *S.NUMERIC).select(
        "risk", *[F.col(c).cast("double").alias(c) for c in S.NUMERIC]
    )
    scores = long.unpivot(["risk"], S.NUMERIC, "feature", "value").groupBy("feature").agg(
        settled(F.abs(F.corr("value", "risk")), 9).alias("importance")
    )
    return Q.top_rows(scores, [F.desc("importance"), "feature"], 15)


@register(
    "o05_top_absolute",
    over_jobs(
        f""", d AS (SELECT job_title, {r('(avg(risk) - (SELECT avg(risk) FROM jobs))')} AS diff
                    FROM jobs GROUP BY job_title)
        SELECT job_title, diff FROM d ORDER BY abs(diff) DESC, job_title LIMIT 15"""
    ),
)
def top_absolute(spark, sf_dir):
    rows = jobs(spark, sf_dir, "job_title", "risk")
    overall = rows.agg(F.avg("risk")).scalar()
    means = rows.groupBy("job_title").agg(F.avg("risk").alias("m"))
    diffs = means.select("job_title", settled(F.col("m") - overall).alias("diff"))
    return Q.top_absolute(diffs, "diff", "job_title", 15)


@register(
    "o08_best_row",
    over_jobs(
        f""", m AS (SELECT experience AS k, {r('avg(risk)')} AS score FROM jobs GROUP BY experience)
        SELECT k, score FROM m ORDER BY score DESC LIMIT 1"""
    ),
)
def best_row(spark, sf_dir):
    table = jobs(spark, sf_dir, "experience", "risk").groupBy(F.col("experience").alias("k")).agg(
        settled(F.avg("risk")).alias("score")
    )
    return Q.best_row(table, "score")


@register(
    "o09_competition_rank",
    over_jobs(
        """, m AS (SELECT experience AS k, round_even(avg(risk), 0) AS score FROM jobs GROUP BY experience)
        SELECT k, score, CAST(rank() OVER (ORDER BY score DESC) AS INT) AS rank FROM m"""
    ),
)
def competition_rank(spark, sf_dir):
    table = jobs(spark, sf_dir, "experience", "risk").groupBy(F.col("experience").alias("k")).agg(
        F.bround(F.avg("risk"), 0).alias("score")
    )
    return Q.competition_rank(table, "score")


# --- set operations ---


@register("u01_concatenate", over_jobs(_FIRST_FIVE))
def concatenate(spark, sf_dir):
    rows = scored(spark, sf_dir, "row_id").select("row_id", "prediction")
    high = Q.first_of_each(rows, "prediction", [2], "row_id")
    low = Q.first_of_each(rows, "prediction", [0], "row_id")
    return high.unionAll(low)


@register(
    "u02_stack_metrics",
    over_jobs(
        f""", {SCORED_SQL} SELECT 'scored' AS model, {r('avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END)')}
            AS accuracy FROM scored
        UNION ALL SELECT 'always high', {r('avg(CASE WHEN label = 2 THEN 1e0 ELSE 0e0 END)')} FROM scored"""
    ),
)
def stack_metrics(spark, sf_dir):
    rows = scored(spark, sf_dir)
    one = lambda name, hit: rows.agg(F.avg(hit.cast("double")).alias("accuracy")).select(
        F.lit(name).alias("model"), "accuracy"
    )
    first = one("scored", F.col("label") == F.col("prediction"))
    return rounded(first.unionByName(one("always high", F.col("label") == 2)))
