"""Grouped summaries, cross-tabs and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskgrove.operators.common import as_rows, distinct_levels, level_table
from riskgrove.operators.ranks import quantile_columns


def group_medians(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Exact median per group, largest first."""
    medians = quantile_columns(rows, [value], {"median": 0.5}, [by])
    return medians.select(by, "median").orderBy(F.desc("median"), by)


def level_means(rows: DataFrame, level: str, levels: list[str], value: str, digits: int = 2) -> DataFrame:
    """Mean per level in level order; a level without rows stays, with a null mean."""
    means = rows.groupBy(F.col(level).alias("level")).agg(F.avg(value).alias("mean"))
    return (
        level_table(rows, levels, "level")
        .join(means, "level", "left")
        .select("level", "rank", F.bround("mean", digits).alias("mean"))
        .orderBy("rank")
    )


def row_shares(
    rows: DataFrame, categories: list[str], column: str, levels: list[str], digits: int | None = None
) -> DataFrame:
    """Row-normalised cross-tabs (percent) of several categorical columns with one other.

    One pass for all columns. With ``digits`` the share is rounded before it is scaled.
    """
    long = rows.select(column, *[F.col(c).cast("string").alias(c) for c in categories]).unpivot(
        [column], categories, "dimension", "level"
    )
    long = long.where(F.col(column).isNotNull() & F.col("level").isNotNull())
    counts = long.groupBy("dimension", "level").agg(
        F.count("*").alias("__n"),
        *[F.count_if(F.col(column) == value).alias(str(value)) for value in levels],
    )
    share = lambda v: F.col(f"`{v}`") / F.col("__n")
    if digits is not None:
        percent = lambda v: F.bround(share(v), digits) * 100
    else:
        percent = lambda v: share(v) * 100
    return counts.select("dimension", "level", *[percent(v).alias(str(v)) for v in levels])


def pivot_mean(
    rows: DataFrame,
    index: str,
    column: str,
    value: str,
    levels: list[str] | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Mean of a value by two columns. ``order`` re-indexes the rows; missing ones are null."""
    levels = levels or distinct_levels(rows, column)
    table = rows.groupBy(index).pivot(column, levels).agg(F.avg(value))
    if order is None:
        return table
    return (
        level_table(rows, order, index)
        .join(table, index, "left")
        .orderBy("rank")
        .drop("rank")
    )


def compare_means(rows: DataFrame, cols: list[str], high, low) -> DataFrame:
    """Mean per column in two row sets, and the difference in percent of the second."""
    wide = rows.agg(
        *[F.avg(F.when(high, F.col(c))).alias(f"{c}__h") for c in cols],
        *[F.avg(F.when(low, F.col(c))).alias(f"{c}__l") for c in cols],
    )
    means = as_rows(
        wide,
        [
            {"column": F.lit(c), "high_mean": F.col(f"{c}__h"), "low_mean": F.col(f"{c}__l")}
            for c in cols
        ],
    )
    gap = (F.col("high_mean") - F.col("low_mean")) / F.nullif(F.col("low_mean"), F.lit(0.0)) * 100
    return means.withColumn("diff_pct", F.when(F.col("low_mean") != 0, gap).otherwise(0.0))


def group_means(rows: DataFrame, by: str, cols: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def scalars(rows: DataFrame, column: str) -> DataFrame:
    """Mean, sample std, exact quartiles of one column, as one row."""
    quartiles = quantile_columns(rows, [column], {"q25": 0.25, "median": 0.5, "q75": 0.75})
    moments = rows.agg(
        F.lit(column).alias("column"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")
    )
    return moments.join(quartiles, "column")
