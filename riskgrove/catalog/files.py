"""Source and sink round trips; each reads the given tables, writes and reads back."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskgrove.catalog.attribution import shap_table, _SHAP
from riskgrove.catalog.clusters import labelled, _LABELLED
from riskgrove.catalog.encoders import FEATURES, MATRIX_SQL, ROUNDED_SQL
from riskgrove.catalog.registry import RISK_CODE_SQL, over_jobs, r, register, rounded
from riskgrove.catalog.rules import _BASKETS, _baskets
from riskgrove.operators.common import distinct_levels
from riskgrove.plans.prepare import prepare
from riskgrove.session import shared_path
from riskgrove.sources import files as IO, schema as S
from riskgrove.sources.tables import jobs


@register(
    "io01_read_raw",
    over_jobs(
        f"""SELECT job_title, education, experience, openings_now, openings_future, {r('salary')} AS salary,
            {r('risk')} AS risk, location FROM jobs"""
    ),
)
def read_raw(spark, sf_dir):
    """Write the table as the raw CSV, read it back under the fixed schema."""
    path = shared_path(spark, "raw")
    names = {name: raw for raw, name, _ in S.RAW_COLUMNS}
    raw = jobs(spark, sf_dir, *names).withColumnsRenamed(names)
    IO.write_table(raw, path, "csv")
    rows = IO.read_raw(spark, path)
    return rounded(
        rows.select(
            "job_title", "education", "experience", "openings_now", "openings_future", "salary", "risk", "location"
        )
    )


def _write_prepared(spark, sf_dir) -> str:
    path = shared_path(spark, "prepared")
    IO.write_table(prepare(jobs(spark, sf_dir)).rows, path)
    return path


@register(
    "io02_read_features",
    over_jobs(MATRIX_SQL + f"SELECT row_id, {ROUNDED_SQL} FROM matrix WHERE split = 'test'"),
)
def read_features(spark, sf_dir):
    rows = IO.read_table(spark, _write_prepared(spark, sf_dir))
    return rounded(rows.where(F.col("split") == "test").select("row_id", *FEATURES))


@register("io03_read_target", over_jobs(f"SELECT {RISK_CODE_SQL} AS label FROM jobs"))
def read_target(spark, sf_dir):
    return IO.read_target(spark, _write_prepared(spark, sf_dir), "label")


@register(
    "io04_csv_sink",
    over_jobs(_BASKETS + " SELECT row_id, CAST(to_json(items) AS VARCHAR) AS items FROM baskets"),
)
def csv_sink(spark, sf_dir):
    path = shared_path(spark, "baskets")
    IO.write_table(_baskets(spark, sf_dir, "row_id"), path, "csv")
    schema = "row_id string, items string"
    return spark.read.schema(schema).option("header", True).option("escape", "\\").csv(path)


@register(
    "io04_parquet_sink",
    over_jobs(_BASKETS + " SELECT row_id, array_to_string(items, ', ') AS items FROM baskets"),
)
def parquet_sink(spark, sf_dir):
    path = shared_path(spark, "baskets")
    IO.write_table(_baskets(spark, sf_dir, "row_id"), path)
    return IO.read_table(spark, path).select("row_id", F.array_join("items", ", ").alias("items"))


@register(
    "io05_csv_with_index",
    over_jobs(f"{_LABELLED} SELECT cluster, {r('avg(risk)')} AS risk_mean, count(*) AS n FROM labelled GROUP BY cluster"),
)
def csv_with_index(spark, sf_dir):
    path = shared_path(spark, "statistics")
    stats = labelled(spark, sf_dir, "risk").groupBy("cluster").agg(
        F.avg("risk").alias("risk_mean"), F.count("*").alias("n")
    )
    IO.write_table(stats, path, "csv")
    schema = "cluster int, risk_mean double, n bigint"
    return rounded(IO.read_table(spark, path, "csv", schema))


@register("io06_saved_model")
def saved_model(spark, sf_dir):
    rows = jobs(spark, sf_dir, "row_id", "salary", "remote")
    stages = [
        VectorAssembler(inputCols=["salary", "remote"], outputCol="v"),
        StandardScaler(inputCol="v", outputCol="scaled", withMean=True),
    ]
    path = shared_path(spark, "scaler")
    IO.save_model(Pipeline(stages=stages).fit(rows), path)
    scaled = IO.load_model(path).transform(rows).withColumn("scaled", vector_to_array("scaled"))
    return scaled.select(
        "row_id", F.col("scaled")[0].alias("salary"), F.col("scaled")[1].alias("remote")
    )


@register(
    "io07_feature_names",
    over_jobs(
        """, listed AS (SELECT 'industry_' || industry AS feature FROM jobs GROUP BY industry
                        HAVING industry > (SELECT min(industry) FROM jobs))
        SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INT) AS position, feature FROM listed"""
    ),
)
def feature_names(spark, sf_dir):
    levels = distinct_levels(jobs(spark, sf_dir, "industry"), "industry")
    path = shared_path(spark, "names")
    IO.save_features(spark, [f"industry_{x}" for x in levels[1:]], path)
    return spark.createDataFrame(list(enumerate(IO.load_features(path))), "position int, feature string")


@register(
    "io08_attribution_table",
    over_jobs(_SHAP + f" SELECT class, feature, count(*) AS n, {r('sum(shap)', 4)} AS total FROM shap GROUP BY ALL"),
)
def attribution_table(spark, sf_dir):
    path = shared_path(spark, "attributions")
    IO.write_attributions(shap_table(spark, sf_dir), path)
    back = spark.read.parquet(path)
    sums = back.groupBy("class", "feature").agg(F.count("*").alias("n"), F.sum("shap").alias("total"))
    return rounded(sums, 4)
