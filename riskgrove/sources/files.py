"""File sources and sinks: the raw CSV, prepared tables, fitted models, feature lists."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskgrove.sources.schema import RAW_SCHEMA, RAW_TO_ANALYSIS


def read_raw(spark: SparkSession, path: str, rename: bool = True) -> DataFrame:
    """The 13-column raw CSV with header, under its fixed schema; a wrong field fails."""
    rows = (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return rows.withColumnsRenamed(RAW_TO_ANALYSIS) if rename else rows


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a table; nested columns become JSON text when the format is CSV."""
    if kind == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        rows = rows.select(
            *[
                F.to_json(F.col(f"`{f.name}`")).alias(f.name)
                if isinstance(f.dataType, nested)
                else F.col(f"`{f.name}`")
                for f in rows.schema.fields
            ]
        )
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").format(kind).save(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def read_target(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a prepared table."""
    return spark.read.parquet(path).select(column)


def save_model(model: Transformer, path: str) -> None:
    """Save a fitted stage or pipeline."""
    if not isinstance(model, PipelineModel):
        model = PipelineModel(stages=[model])
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_features(spark: SparkSession, names: list[str], path: str) -> None:
    """Keep an ordered feature list as the assembler stage that uses it."""
    Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features")]).write().overwrite().save(path)


def load_features(path: str) -> list[str]:
    return Pipeline.load(path).getStages()[0].getInputCols()


def write_attributions(rows: DataFrame, path: str) -> None:
    """The long attribution table, one folder per class.

    Classes are few, so a task keeps a file open for each instead of sorting its rows by class,
    which would spill them all.
    """
    spark, name = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, "0")
    spark.conf.set(name, "16")
    try:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("class").parquet(path)
    finally:
        spark.conf.set(name, before)
