"""Row selection, top lists and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.operators.common import as_rows
from riskgrove.operators.ranks import (
    counted_values,
    named_quantiles,
    running_counts,
)


def extremes(rows: DataFrame, column: str, high: float = 80, low: float = 20) -> DataFrame:
    """Counts and shares (percent, one decimal) of the rows above and below two limits."""
    wide = rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(column) > high).alias("h"),
        F.count_if(F.col(column) < low).alias("l"),
    )
    record = lambda name, c: {
        "subset": F.lit(name),
        "n": F.col(c),
        "pct": F.bround(F.col(c) * 100.0 / F.col("n"), 1),
    }
    return as_rows(wide, [record("high", "h"), record("low", "l")])


def iqr_outliers(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Bounds at 1.5 IQR beyond the quartiles, and how many values lie outside."""
    counts = counted_values(rows, cols)
    quartiles = named_quantiles(counts, ["column"], {"q1": 0.25, "q3": 0.75})
    bounds = quartiles.select(
        "column",
        (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper"),
    )
    value = F.col("value")
    outside = (value < F.col("lower")) | (value > F.col("upper"))
    beyond = F.sum(F.when(outside, F.col("ties")).otherwise(0))
    return (
        counts.join(bounds, "column")
        .groupBy("column", "lower", "upper")
        .agg(
            beyond.alias("n_outliers"),
            F.bround(beyond * 100.0 / F.sum("ties"), 2).alias("pct"),
        )
    )


def top_counts(rows: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The most frequent values."""
    return (
        rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
    )


def top_rows(rows: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def top_absolute(rows: DataFrame, column: str, tie: str, n: int = 15) -> DataFrame:
    return rows.orderBy(F.abs(column).desc(), tie).limit(n)


def first_match(rows: DataFrame, test: Column, key: str, fallback: int = 0) -> DataFrame:
    """The first row by key that passes a test, else the row at the fallback position."""
    hit = rows.where(test).orderBy(key).limit(1).withColumn("__order", F.lit(0))
    back = (
        rows.orderBy(key).limit(fallback + 1).orderBy(F.desc(key)).limit(1)
    ).withColumn("__order", F.lit(1))
    return hit.unionByName(back).orderBy("__order").limit(1).drop("__order")


def first_of_each(rows: DataFrame, column: str, values: list, key: str, n: int = 5) -> DataFrame:
    """The first rows by key of each of a few classes, stacked."""
    parts = [rows.where(F.col(column) == v).orderBy(key).limit(n) for v in values]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def head_sample(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """The first n rows by key; all rows when no size is given."""
    return rows if n is None else rows.orderBy(key).limit(n)


def hash_order(key: str, seed: int) -> Column:
    """A repeatable shuffle of the rows: the digest of key and seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def random_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows without replacement."""
    return rows.orderBy(hash_order(key, seed), key).limit(n)


def keep_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs in another table."""
    return rows.join(keys.select(key), key, "left_semi")


def best_row(rows: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """The row with the largest (or smallest) metric."""
    names = [F.col(c) for c in rows.columns]
    pick = F.max_by if largest else F.min_by
    return rows.agg(pick(F.struct(*names), F.col(metric)).alias("r")).select("r.*")


def competition_rank(rows: DataFrame, metric: str, out: str = "rank") -> DataFrame:
    """Rank, best first; ties share the smallest rank."""
    counts = rows.groupBy(metric).agg(F.count("*").alias("__ties"))
    ran = running_counts(counts, [], metric, {"__before": "__ties"})
    better = F.col("__before_all") - F.col("__before") - F.col("__ties")
    return rows.join(ran.select(metric, (better + 1).cast("int").alias(out)), metric)
