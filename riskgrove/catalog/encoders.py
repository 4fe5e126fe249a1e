"""Encoder, scaler and information queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrove.catalog.features import CODES_SQL, DERIVED_SQL
from riskgrove.catalog.models import matrix_scaler, prepared
from riskgrove.catalog.profiles import split_jobs, split_sql
from riskgrove.catalog.registry import (
    RISK_CODE_SQL,
    over_jobs,
    r,
    register,
    rounded,
    settled,
    sql_long,
)
from riskgrove.functions.binning import cut
from riskgrove.operators import encode as E, profile as P, select as Q
from riskgrove.operators.common import distinct_levels
from riskgrove.operators.information import INSIDE, mutual_information, nearest_information
from riskgrove.plans.prepare import DUMMIES, feature_names, prepare
from riskgrove.session import shared_path
from riskgrove.sources import files as IO, schema as S
from riskgrove.sources.tables import jobs

_SIGMOID = "1 / (1 + exp(-(n - 20e0) / 10e0))"
_ENCODING = f""", train AS (SELECT * FROM split_rows WHERE split = 'train'),
    prior AS (SELECT avg(risk) AS prior FROM train),
    stats AS (SELECT job_title, avg(risk) AS m, count(risk) AS n FROM train GROUP BY job_title),
    enc AS (SELECT job_title, n, prior * (1 - {_SIGMOID}) + m * ({_SIGMOID}) AS encoded,
                   prior * (1 - n / (n + 10e0)) + m * (n / (n + 10e0)) AS additive FROM stats, prior) """


def _train(spark, sf_dir):
    return split_jobs(spark, sf_dir, "job_title", "risk").where(F.col("split") == "train")


@register(
    "k09_target_encoding",
    over_jobs(split_sql(RISK_CODE_SQL) + _ENCODING + f"SELECT job_title, {r('encoded')} AS encoded, n FROM enc"),
)
def target_encoding(spark, sf_dir):
    return rounded(E.target_encoding(_train(spark, sf_dir), "job_title", "risk"))


@register(
    "k09_target_encoding_additive",
    over_jobs(split_sql(RISK_CODE_SQL) + _ENCODING + f"SELECT job_title, {r('additive')} AS encoded, n FROM enc"),
)
def target_encoding_additive(spark, sf_dir):
    return rounded(E.target_encoding(_train(spark, sf_dir), "job_title", "risk", method="additive"))


@register(
    "j04_encoding_lookup",
    over_jobs(
        split_sql(RISK_CODE_SQL)
        + _ENCODING
        + f"""SELECT row_id, split, {r('coalesce(encoded, prior)')} AS job_title_encoded
              FROM split_rows LEFT JOIN enc USING (job_title), prior"""
    ),
)
def encoding_lookup(spark, sf_dir):
    rows = split_jobs(spark, sf_dir, "job_title")
    train = _train(spark, sf_dir)
    encoding = E.target_encoding(train, "job_title", "risk")
    out = E.apply_target_encoding(rows, encoding, train, "job_title", "risk", "job_title_encoded")
    return rounded(out.select("row_id", "split", "job_title_encoded"))


@register(
    "io06_saved_encoding",
    over_jobs(
        split_sql(RISK_CODE_SQL)
        + _ENCODING
        + f"""SELECT row_id, {r('coalesce(encoded, prior)')} AS job_title_encoded
              FROM split_rows LEFT JOIN enc USING (job_title), prior WHERE split = 'test'"""
    ),
)
def saved_encoding(spark, sf_dir):
    """Fitted to training rows and saved; test rows are encoded by what was loaded."""
    path = shared_path(spark, "encoding")
    IO.write_table(E.fitted_encoding(_train(spark, sf_dir), "job_title", "risk"), path)
    test = split_jobs(spark, sf_dir, "job_title").where("split = 'test'")
    out = E.apply_fitted_encoding(test, IO.read_table(spark, path), "job_title", "job_title_encoded")
    return rounded(out.select("row_id", "job_title_encoded"))


# The levels of the two one-hot columns in the given tables, in sorted order.
_LEVELS = {
    "industry": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "location": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
}


@register(
    "k10_one_hot",
    over_jobs(
        "SELECT row_id, "
        + ", ".join(
            f"CASE WHEN {c} = '{x}' THEN 1 ELSE 0 END AS \"{c}_{x}\"" for c in DUMMIES for x in _LEVELS[c][1:]
        )
        + " FROM jobs"
    ),
)
def one_hot(spark, sf_dir):
    return E.one_hot(jobs(spark, sf_dir, "row_id", *DUMMIES), DUMMIES)


# The whole prepared matrix as CTE ``matrix``.
FEATURES = feature_names(_LEVELS)
SCALED = [c for c in FEATURES if not any(c.startswith(f"{d}_") for d in DUMMIES)]
_COLUMN_SQL = {
    **{c: f"split_rows.{c}" for c in S.NUMERIC},
    **{c: f"coalesce({sql}, 0)" for c, sql in DERIVED_SQL.items()},
    "salary_zscore": "coalesce((salary - z.m) / z.sd, 0)",
    **{c: f"coalesce({sql}, 0)" for c, sql in CODES_SQL.items()},
    "job_title_encoded": "coalesce(encoded, prior)",
    **{f"{c}_{x}": f"CASE WHEN {c} = '{x}' THEN 1 ELSE 0 END" for c in DUMMIES for x in _LEVELS[c][1:]},
}
MATRIX_SQL = (
    split_sql(RISK_CODE_SQL)
    + _ENCODING
    + ", z AS (SELECT avg(salary) AS m, stddev_samp(salary) AS sd FROM train), matrix AS (SELECT row_id, label, split, "
    + ", ".join(f'{_COLUMN_SQL[c]} AS "{c}"' for c in FEATURES)
    + " FROM split_rows LEFT JOIN enc USING (job_title), prior, z) "
)
_DOUBLES = {"salary", "remote", "diversity", "salary_zscore", "job_title_encoded", *DERIVED_SQL}
ROUNDED_SQL = ", ".join(r(f'"{c}"') + f' AS "{c}"' if c in _DOUBLES else f'"{c}"' for c in FEATURES)


def _scale_sql(cols: list[str], fitted: str) -> str:
    stats = ", ".join(f'avg("{c}") AS m{i}, stddev_pop("{c}") AS s{i}' for i, c in enumerate(cols))
    scale = lambda i: f"CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END"
    scaled = ", ".join(r(f'("{c}" - m{i}) / {scale(i)}') + f' AS "{c}"' for i, c in enumerate(cols))
    return MATRIX_SQL + f", fit AS (SELECT {stats} FROM {fitted}) SELECT row_id, {scaled} FROM matrix, fit"


@register("k11_standardise_on_train", over_jobs(_scale_sql(SCALED, "(SELECT * FROM matrix WHERE split = 'train')")))
def standardise_on_train(spark, sf_dir):
    """All columns but the dummies, by the training rows."""
    ready = prepared(spark, sf_dir)
    cols = ready.scaled_features
    return rounded(E.scale(ready.rows, cols, E.scaler_numbers(ready.train, cols)).select("row_id", *cols))


@register(
    "io06_saved_scaler",
    over_jobs(_scale_sql(SCALED, "(SELECT * FROM matrix WHERE split = 'train')") + " WHERE split = 'test'"),
)
def saved_scaler(spark, sf_dir):
    """Fitted to training rows and saved; test rows are scaled by what was loaded."""
    ready = prepare(jobs(spark, sf_dir))
    cols, path = ready.scaled_features, shared_path(spark, "scaler")
    IO.write_table(E.fitted_scaler(ready.train, cols), path)
    scaled = E.apply_fitted_scaler(ready.test, IO.read_table(spark, path), cols)
    return rounded(scaled.select("row_id", *cols))


@register("k12_standardise_all", over_jobs(_scale_sql(FEATURES, "matrix")))
def standardise_all(spark, sf_dir):
    """The whole matrix, dummies too, by all rows."""
    ready = prepared(spark, sf_dir)
    scaled = E.scale(ready.rows, ready.features, matrix_scaler(spark, sf_dir))
    return rounded(scaled.select("row_id", *ready.features))


@register(
    "x10_feature_list",
    over_jobs(
        ", names AS (SELECT unnest(["
        + ", ".join(f"'{c}'" for c in feature_names({c: [""] for c in DUMMIES}))
        + """]) AS feature, generate_subscripts(["""
        + ", ".join("1" for _ in feature_names({c: [""] for c in DUMMIES}))
        + """], 1) AS pos),
        levels AS (SELECT 1 AS block, 'industry_' || industry AS feature FROM jobs GROUP BY industry
                   HAVING industry > (SELECT min(industry) FROM jobs)
                   UNION ALL SELECT 2, 'location_' || location FROM jobs GROUP BY location
                   HAVING location > (SELECT min(location) FROM jobs)),
        listed AS (SELECT 0 AS block, pos, feature FROM names
                  UNION ALL SELECT block, row_number() OVER (PARTITION BY block ORDER BY feature), feature FROM levels)
        SELECT CAST(row_number() OVER (ORDER BY block, pos) - 1 AS INT) AS position, feature FROM listed"""
    ),
)
def feature_list(spark, sf_dir):
    raw = jobs(spark, sf_dir, *DUMMIES)
    names = feature_names({c: distinct_levels(raw, c) for c in DUMMIES})
    return spark.createDataFrame(list(enumerate(names)), "position int, feature string")


@register(
    "p13_matrix_quality",
    over_jobs(
        MATRIX_SQL
        + "SELECT split, count(*) AS n_rows, CAST("
        + " + ".join(f'count(*) - count("{c}")' for c in FEATURES)
        + " AS BIGINT) AS n_missing, CAST("
        + " + ".join(f'count(CASE WHEN isinf(CAST("{c}" AS DOUBLE)) THEN 1 END)' for c in FEATURES)
        + " AS BIGINT) AS n_infinite FROM matrix GROUP BY split"
    ),
)
def matrix_quality(spark, sf_dir):
    """Missing and infinite cells of all features, by split."""
    ready = prepare(jobs(spark, sf_dir))
    return P.quality(ready.rows.select("split", *[F.col(c).cast("double").alias(c) for c in ready.features]), "split")


@register("x10_feature_matrix", over_jobs(MATRIX_SQL + f"SELECT row_id, label, split, {ROUNDED_SQL} FROM matrix"))
def feature_matrix(spark, sf_dir):
    ready = prepare(jobs(spark, sf_dir))
    return rounded(ready.rows.select("row_id", "label", "split", *ready.features))


_MI_FEATURES = [*S.NUMERIC, "salary_per_experience"]


def _information_sql(long: str) -> str:
    """CTE ``info`` from the text of an unpivot into (label, column, value)."""
    return f""", long AS ({long}),
        e AS (SELECT "column", quantile_cont(value, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS edges
              FROM long GROUP BY "column"),
        b AS (SELECT "column", label, len(list_filter(edges, lambda x: x < value)) AS bin FROM long JOIN e USING ("column")),
        j AS (SELECT "column", bin, label, count(*) * 1e0 AS n FROM b GROUP BY ALL),
        w AS (SELECT *, sum(n) OVER (PARTITION BY "column", bin) AS nb, sum(n) OVER (PARTITION BY "column", label) AS nl,
                     sum(n) OVER (PARTITION BY "column") AS total FROM j),
        info AS (SELECT "column" AS feature, sum(n / total * ln(n * total / (nb * nl))) AS mi FROM w GROUP BY "column") """


@register(
    "l10_mutual_information",
    over_jobs(
        f", wide AS (SELECT *, salary / (experience + 1) AS salary_per_experience, {RISK_CODE_SQL} AS label FROM jobs)"
        + _information_sql(sql_long(_MI_FEATURES, "label", "wide"))
        + f"SELECT feature, {r('mi', 9)} AS mutual_info FROM info"
    ),
)
def mutual_info(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", *S.NUMERIC, heavy=True).withColumn(
        "salary_per_experience", F.col("salary") / (F.col("experience") + 1)
    ).withColumn("label", cut("risk", S.RISK_EDGES, S.RISK_CODES))
    found = mutual_information(rows, _MI_FEATURES, "label")
    return found.withColumn("mutual_info", settled("mutual_info", 9))


@register(
    "l10_top_information",
    over_jobs(
        MATRIX_SQL
        + _information_sql(
            " UNION ALL ".join(
                f"""SELECT label, '{c}' AS "column", CAST("{c}" AS DOUBLE) AS value FROM matrix WHERE split = 'train'"""
                for c in FEATURES
            )
        )
        + f"SELECT feature, {r('mi')} AS mutual_info FROM info ORDER BY mi DESC, feature LIMIT 10"
    ),
)
def top_information(spark, sf_dir):
    ready = prepared(spark, sf_dir)
    found = mutual_information(ready.train, ready.features, "label")
    return rounded(Q.top_rows(found, [F.desc("mutual_info"), "feature"], 10))


def _digamma_sql(x: str) -> str:
    z, w = f"({x} + 1e1)", f"(1 / ({x} + 1e1) ** 2)"
    steps = " - ".join(f"1 / ({x} + {i}e0)" for i in range(10))
    series = f"{w} * (1 / 12e0 - {w} * (1 / 120e0 - {w} * (1 / 252e0 - {w} * (1 / 240e0 - {w} / 132))))"
    return f"(ln({z}) - 0.5e0 / {z} - {series} - {steps})"


def _nearest_sql(long: str) -> str:
    """CTE ``info`` of the nearest-neighbour estimate (three neighbours), from an unpivot as above."""
    return f""", long AS ({long}),
        c AS (SELECT "column", label, value, count(*) AS ties FROM long WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
        s AS (SELECT *, CAST(sum(ties) OVER (PARTITION BY "column", label) AS BIGINT) AS nl FROM c QUALIFY nl > 1),
        near AS (SELECT *, list({{'v': value, 'n': ties}}) OVER (PARTITION BY "column", label ORDER BY value
                        ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near,
                        CAST(sum(ties) OVER (PARTITION BY "column", value) AS BIGINT) AS same,
                        CAST(sum(ties) OVER (PARTITION BY "column") AS BIGINT) AS total FROM s),
        d AS (SELECT *, list_sort(flatten(list_transform(near, lambda e: list_transform(
                        range(least(3, e.n - CASE WHEN e.v = value THEN 1 ELSE 0 END)), lambda i: abs(e.v - value)))))[least(3, nl - 1)] AS radius
              FROM near),
        ends AS (SELECT *, value - radius * {INSIDE!r}e0 AS lo, value + radius * {INSIDE!r}e0 AS hi FROM d),
        upto AS (SELECT "column", value, CAST(sum(sum(ties)) OVER (PARTITION BY "column" ORDER BY value) AS BIGINT) AS upto
                 FROM s GROUP BY "column", value),
        met AS (SELECT e.*, CASE WHEN radius = 0 THEN ties ELSE least(3, nl - 1) END * 1e0 AS k,
                       CASE WHEN radius = 0 THEN same ELSE h.upto - coalesce(l.upto, 0) END * 1e0 AS inside, nl * 1e0 AS of_label
                FROM ends e ASOF LEFT JOIN upto h ON e."column" = h."column" AND e.hi > h.value
                ASOF LEFT JOIN upto l ON e."column" = l."column" AND e.lo >= l.value),
        info AS (SELECT "column" AS feature, greatest(0e0, any_value({_digamma_sql("total")})
                        + sum(ties * ({_digamma_sql("k")} - {_digamma_sql("of_label")} - {_digamma_sql("inside")})) / any_value(total)) AS mi
                 FROM met GROUP BY "column") """


@register(
    "l10_nearest_information",
    over_jobs(
        f", wide AS (SELECT *, salary / (experience + 1) AS salary_per_experience, {RISK_CODE_SQL} AS label FROM jobs)"
        + _nearest_sql(sql_long(_MI_FEATURES, "label", "wide"))
        + f"SELECT feature, {r('mi')} AS mutual_info FROM info"
    ),
)
def nearest_info(spark, sf_dir):
    rows = jobs(spark, sf_dir, "risk", *S.NUMERIC, heavy=True).withColumn(
        "salary_per_experience", F.col("salary") / (F.col("experience") + 1)
    ).withColumn("label", cut("risk", S.RISK_EDGES, S.RISK_CODES))
    return rounded(nearest_information(rows, _MI_FEATURES, "label"))


@register(
    "l10_top_nearest_information",
    over_jobs(
        MATRIX_SQL
        + _nearest_sql(
            " UNION ALL ".join(
                f"""SELECT label, '{c}' AS "column", CAST("{c}" AS DOUBLE) AS value FROM matrix WHERE split = 'train'"""
                for c in FEATURES
            )
        )
        + f"SELECT feature, {r('mi')} AS mutual_info FROM info ORDER BY mi DESC, feature LIMIT 10"
    ),
)
def top_nearest_information(spark, sf_dir):
    ready = prepared(spark, sf_dir)
    found = nearest_information(ready.train, ready.features, "label")
    return rounded(Q.top_rows(found, [F.desc("mutual_info"), "feature"], 10))
