"""The tables behind distribution plots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.operators.common import level_table, one_row
from riskgrove.operators.ranks import (
    attach_small,
    counted_values,
    long_form,
    named_quantiles,
    quantile_columns,
    running_counts,
)

#: Bandwidths that a value reaches by default: a Gaussian beyond nine adds less than 3e-18 of its
#: peak. ``reach=None`` asks for the full sum.
REACH = 9.0


def histogram(rows: DataFrame, column: str, bins: int, density: bool = False) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed, empty bins are kept."""
    values = rows.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    ends = one_row(values, lo=F.min("x"), hi=F.max("x"), n=F.count("x"))
    lo, hi = ends.getField("lo"), ends.getField("hi")
    width = (hi - lo) / bins
    raw = F.least(F.floor((F.col("x") - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins), F.lit(bins - 1))
    placed = values.select("x", F.coalesce(raw, F.lit(0)).cast("int").alias("b"))
    # Settle values next to an edge by comparing them with the edge itself.
    below = F.col("x") < lo + F.col("b") * width
    above = (F.col("x") >= lo + (F.col("b") + 1) * width) & (F.col("b") < bins - 1)
    counts = (
        placed.select(
            F.when(below, F.col("b") - 1).when(above, F.col("b") + 1).otherwise(F.col("b")).alias("bin")
        )
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = F.coalesce(F.col("n"), F.lit(0))
    out = [
        F.col("bin"),
        (lo + F.col("bin") * width).alias("lower"),
        F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("upper"),
        n.alias("n"),
    ]
    if density:
        out.append(F.try_divide(n, ends.getField("n") * width).alias("density"))
    return grid.join(counts, "bin", "left").select(*out)


def centre_lines(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and exact median per column."""
    medians = quantile_columns(rows, cols, {"median": 0.5})
    means = long_form(rows, cols).groupBy("column").agg(F.avg("value").alias("mean"))
    return means.join(medians, "column")


def _spread(x: Column, lo: Column, step: Column, h: Column, points: int, reach: float | None) -> Column:
    """Indexes of the grid points within reach of a value."""
    if reach is None:
        return F.when((step > 0) & (h > 0), F.sequence(F.lit(0), F.lit(points - 1)))
    first = F.greatest(F.ceil((x - reach * h - lo) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((x + reach * h - lo) / step), F.lit(points - 1)).cast("int")
    return F.when(first <= last, F.sequence(first, last))


def kde(rows: DataFrame, column: str, points: int = 1000, reach: float | None = REACH) -> DataFrame:
    """Gaussian density with Scott's bandwidth on a grid half a range wider on each side.

    Each distinct value reaches only the grid points within ``reach`` bandwidths, so the work
    per value shrinks as the table grows.
    """
    values = rows.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    stats = one_row(
        values, lo=F.min("x"), hi=F.max("x"), std=F.stddev_samp("x"), n=F.count("x").cast("double")
    )
    width = stats.getField("hi") - stats.getField("lo")
    lo = stats.getField("lo") - 0.5 * width
    step = 2.0 * width / (points - 1)
    h = stats.getField("std") * F.pow(stats.getField("n"), F.lit(-0.2))
    counts = values.groupBy("x").agg(F.count("*").alias("ties"))
    near = counts.select("x", "ties", F.explode(_spread(F.col("x"), lo, step, h, points, reach)).alias("point"))
    u = (lo + F.col("point") * step - F.col("x")) / h
    mass = near.groupBy("point").agg(F.sum(F.col("ties") * F.exp(-0.5 * u * u)).alias("mass"))
    grid = rows.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    scale = stats.getField("n") * h * math.sqrt(2 * math.pi)
    return grid.join(mass, "point", "left").select(
        "point",
        (lo + F.col("point") * step).alias("x"),
        (F.coalesce(F.col("mass"), F.lit(0.0)) / scale).alias("density"),
    )


def kde_groups(
    rows: DataFrame, cols: list[str], group: str, points: int = 200, cut: float = 3.0,
    reach: float | None = REACH,
) -> DataFrame:
    """One density per column and group, on its own grid, scaled by the group's share."""
    long = long_form(rows, cols, [group]).where(F.col(group).isNotNull())
    keys = [group, "column"]
    per_group = long.groupBy(*keys).agg(
        F.min("value").alias("vmin"),
        F.max("value").alias("vmax"),
        F.count("*").cast("double").alias("n"),
        F.stddev_samp("value").alias("std"),
    )
    totals = per_group.groupBy("column").agg(F.sum("n").alias("n_all"))
    h = F.col("std") * F.pow(F.col("n"), F.lit(-0.2))
    frame = per_group.join(totals, "column").select(
        *keys,
        "n",
        "n_all",
        h.alias("h"),
        (F.col("vmin") - cut * h).alias("lo"),
        ((F.col("vmax") + cut * h - (F.col("vmin") - cut * h)) / (points - 1)).alias("step"),
    )
    counts = long.groupBy(*keys, "value").agg(F.count("*").alias("ties"))
    near = attach_small(counts, frame.select(*keys, "h", "lo", "step"), keys).select(
        *keys,
        "value",
        "ties",
        "h",
        "lo",
        "step",
        F.explode(
            _spread(F.col("value"), F.col("lo"), F.col("step"), F.col("h"), points, reach)
        ).alias("point"),
    )
    u = (F.col("lo") + F.col("point") * F.col("step") - F.col("value")) / F.col("h")
    mass = near.groupBy(*keys, "point").agg(F.sum(F.col("ties") * F.exp(-0.5 * u * u)).alias("mass"))
    grid = frame.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    scale = F.col("n_all") * F.col("h") * math.sqrt(2 * math.pi)
    return grid.join(mass, [*keys, "point"], "left").select(
        *keys,
        "point",
        (F.col("lo") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce(F.col("mass"), F.lit(0.0)) / scale).alias("density"),
    )


def ecdf(rows: DataFrame, column: str) -> DataFrame:
    """The empirical distribution function, one row per distinct value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("ties"))
    ran = running_counts(counts, [], column, {"before": "ties"})
    return ran.select(
        column, "ties", ((F.col("before") + F.col("ties")) / F.col("before_all")).alias("fraction")
    )


def box_stats(rows: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Quartiles, whiskers at the furthest points within 1.5 IQR, and the flier count."""
    by = by or []
    keys = [*by, "column"]
    counts = counted_values(rows, cols, by)
    quartiles = named_quantiles(counts, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    fenced = quartiles.withColumns(
        {
            "lower": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
            "upper": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
        }
    )
    value = F.col("value")
    inside = (value >= F.col("lower")) & (value <= F.col("upper"))
    # Left to Spark: the fences turn out small at run time and the counted values, shuffled
    # once for both sides, need no second look at the input.
    whiskers = (
        counts.join(fenced, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.sum("ties").alias("n"),
            F.min(F.when(inside, value)).alias("low"),
            F.max(F.when(inside, value)).alias("high"),
            F.sum(F.when(inside, 0).otherwise(F.col("ties"))).alias("fliers"),
        )
    )
    return whiskers.select(
        *keys,
        "n",
        "q1",
        "median",
        "q3",
        F.least("low", "q1").alias("whisker_low"),
        F.greatest("high", "q3").alias("whisker_high"),
        "fliers",
    )


def box_stats_by_category(rows: DataFrame, value: str, categories: list[str]) -> DataFrame:
    """Box statistics of one column for every level of several categorical columns."""
    long = rows.unpivot([value], categories, "dimension", "level")
    return box_stats(long, [value], ["dimension", "level"]).drop("column")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts per value, most frequent first."""
    return (
        rows.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def level_counts(rows: DataFrame, column: str, levels: list[str], digits: int = 2) -> DataFrame:
    """Count and percentage of all rows per level, in level order, empty levels kept."""
    counts = rows.groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*")).scalar()
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        level_table(rows, [str(x) for x in levels], "level")
        .join(counts, "level", "left")
        .select("level", "rank", n.alias("n"), F.bround(n * 100.0 / total, digits).alias("pct"))
        .orderBy("rank")
    )


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Share of each value among the non-null rows."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, (F.col("n") / total).alias("share"))
