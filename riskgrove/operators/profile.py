"""Table profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskgrove.operators.common import as_rows, is_missing
from riskgrove.operators.ranks import quantile_columns


def shape(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(rows.columns)))


def column_info(rows: DataFrame) -> DataFrame:
    """Type and non-null count per column, in one pass."""
    fields = rows.schema.fields
    counts = rows.agg(*[F.count_if(~is_missing(f)).alias(f.name) for f in fields])
    return as_rows(
        counts,
        [
            {
                "column": F.lit(f.name),
                "dtype": F.lit(f.dataType.simpleString()),
                "non_null": F.col(f.name),
            }
            for f in fields
        ],
    )


def preview(rows: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def missing_report(rows: DataFrame) -> DataFrame:
    """Missing count and percentage (two decimals) per column, in one pass."""
    fields = rows.schema.fields
    counts = rows.agg(
        F.count("*").alias("__n"), *[F.count_if(is_missing(f)).alias(f.name) for f in fields]
    )
    return as_rows(
        counts,
        [
            {
                "column": F.lit(f.name),
                "missing": F.col(f.name),
                "missing_pct": F.bround(F.try_divide(F.col(f.name) * 100.0, F.col("__n")), 2),
            }
            for f in fields
        ],
    )


def describe_numeric(rows: DataFrame, cols: list[str], digits: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max per column."""
    aggregates = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    wide = rows.agg(*[f(value(c)).alias(f"{c}__{n}") for c in cols for n, f in aggregates.items()])
    moments = as_rows(
        wide,
        [{"column": F.lit(c), **{n: F.col(f"{c}__{n}") for n in aggregates}} for c in cols],
    )
    quartiles = quantile_columns(rows, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    out = moments.join(quartiles, "column", "left")
    order = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    rounded = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: F.col(c))
    return out.select("column", "count", *[rounded(c).alias(c) for c in order])


def describe_categorical(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Count, distinct values, most frequent value (smallest on ties) and its frequency."""
    long = rows.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value"
    )
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count("*").alias("n")
    )
    top = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value")))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"), top.alias("best")
    ).select(
        "column",
        "count",
        "unique",
        F.col("best.value").alias("top"),
        (-F.col("best.neg")).alias("freq"),
    )


def duplicates(rows: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, as a count and a percentage."""
    copies = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    n = F.sum("__n")
    return copies.agg(
        F.coalesce(n - F.count("*"), F.lit(0)).alias("duplicates"),
        F.bround(F.try_divide((n - F.count("*")) * 100.0, n), 2).alias("duplicate_pct"),
    )


def skewness(col: Column) -> Column:
    """Bias-corrected skewness (G1)."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def excess_kurtosis(col: Column) -> Column:
    """Bias-corrected excess kurtosis (G2)."""
    n = F.count(col).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(col) + 6))


def distinct_counts(rows: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    if approximate:
        wide = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return as_rows(wide, [{"column": F.lit(c), "n_unique": F.col(c)} for c in cols])
    long = rows.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value"
    )
    values = long.where(F.col("value").isNotNull()).distinct()
    return values.groupBy("column").agg(F.count("*").alias("n_unique"))


def value_range(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def quality(rows: DataFrame, by: str) -> DataFrame:
    """Total missing and total infinite cells per group, with the group's row count."""
    fields = [f for f in rows.schema.fields if f.name != by]
    inf = float("inf")
    missing = sum((is_missing(f).cast("long") for f in fields), F.lit(0))
    infinite = sum(
        (
            F.coalesce((F.abs(F.col(f.name)) == inf).cast("long"), F.lit(0))
            for f in fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        ),
        F.lit(0),
    )
    return rows.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.sum(missing).alias("n_missing"),
        F.sum(infinite).alias("n_infinite"),
    )


def class_counts(rows: DataFrame, column: str, classes: list) -> DataFrame:
    """One count per class, each its own predicate, in one pass."""
    return rows.agg(*[F.count_if(F.col(column) == c).alias(f"n_{c}") for c in classes])


def group_shares(rows: DataFrame, by: str) -> DataFrame:
    """Size of each group and its share of all rows (percent, one decimal)."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.select(by, "n", F.bround(F.col("n") * 100.0 / total, 1).alias("pct"))
