"""Correlations, rank tests and a straight-line fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.functions.columns import stars
from riskgrove.functions.tails import chi2_upper, normal_two_sided
from riskgrove.operators.common import one_row
from riskgrove.operators.ranks import (
    SMALL_ROWS,
    average_ranks,
    long_form,
    quantile_columns,
    running_counts,
)
from riskgrove.session import shared_path

STRENGTH = [(0.3, "***"), (0.2, "**"), (0.1, "*")]
SIGNIFICANCE = [(0.001, "***"), (0.01, "**"), (0.05, "*")]


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null when a column is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson_matrix(rows: DataFrame, cols: list[str], lower: bool = False) -> DataFrame:
    """(a, b, r) for all ordered pairs, or the strict lower triangle.

    Rows are laid out per pair and aggregated by pair in the same pass: one small
    aggregate instead of one per pair, and nulls are left out pair by pair.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[: i if lower else i + 1]]
    number = lambda c: F.col(c).cast("double")
    record = lambda a, b: F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"), number(a).alias("x"), number(b).alias("y")
    )
    long = rows.select(F.inline(F.array(*[record(a, b) for a, b in pairs])))
    found = long.groupBy("a", "b").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    if lower:
        return found
    mirrored = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = F.when(F.col("a") == F.col("b"), F.slice(mirrored, 1, 1)).otherwise(mirrored)
    return found.select("r", F.inline(both)).select("a", "b", "r")


def with_ranks(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Replace columns by their average-tie ranks; rows with a null in any are left out.

    Ranks are found per distinct value, once for all columns, and kept as a table. Columns with few
    values get their ranks by a broadcast of known size, the others by an equi-join on the value.
    """
    complete = rows.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    counts = long_form(complete, cols).groupBy("column", "value").agg(F.count("*").alias("ties"))
    counts = counts.withColumn("one", F.lit(1))
    ran = running_counts(counts, ["column"], "value", {"before": "ties", "seen": "one"})
    ran = ran.select("column", "value", (F.col("before") + (F.col("ties") + 1) / 2).alias("rank"), "seen_all")
    path = shared_path(rows.sparkSession, "ranks")
    ran.write.partitionBy("column").parquet(path)
    ran = rows.sparkSession.read.schema(ran.schema).parquet(path)
    few = ran.where(F.col("seen_all") <= SMALL_ROWS).select("column", "value", "rank")
    small: dict[str, list] = {}
    for r in few.collect():
        small.setdefault(r["column"], []).append((r["value"], r["rank"]))
    out = complete
    for c in cols:
        if c in small:
            table = rows.sparkSession.createDataFrame(small[c], f"`{c}` double, `{c}__rank` double")
            out = out.join(F.broadcast(table), c)
        else:
            own = ran.where(F.col("column") == c)
            out = out.join(own.select(F.col("value").alias(c), F.col("rank").alias(f"{c}__rank")), c)
    return out.select(*[F.col(f"{c}__rank").alias(c) for c in cols])


def spearman_matrix(rows: DataFrame, cols: list[str], lower: bool = False) -> DataFrame:
    return pearson_matrix(with_ranks(rows, cols), cols, lower)


def target_correlations(matrix: DataFrame, target: str) -> DataFrame:
    """A matrix's correlations with the target, strongest positive first, with marks."""
    return (
        matrix.where((F.col("b") == target) & (F.col("a") != target))
        .select(
            F.col("a").alias("feature"),
            "r",
            stars(F.abs("r"), STRENGTH, "", below=False).alias("strength"),
        )
        .orderBy(F.desc("r"), "feature")
    )


def kruskal(rows: DataFrame, value: str, categories: list[str]) -> DataFrame:
    """Kruskal-Wallis H with tie correction per categorical column."""
    ranked = average_ranks(rows, value)
    stats = one_row(
        ranked,
        n=F.max("n").cast("double"),
        ties=F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")),
    )
    long = rows.where(F.col(value).isNotNull()).select(
        value, *[F.col(c).cast("string").alias(c) for c in categories]
    )
    groups = (
        long.unpivot([value], categories, "dimension", "level")
        .where(F.col("level").isNotNull())
        .groupBy("dimension", "level", value)
        .agg(F.count("*").alias("m"))
        .join(ranked.select(value, "avg_rank"), value)
        .groupBy("dimension", "level")
        .agg(F.sum(F.col("avg_rank") * F.col("m")).alias("r"), F.sum("m").alias("m"))
    )
    sums = groups.groupBy("dimension").agg(
        F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count("*").alias("groups")
    )
    n, ties = stats.getField("n"), stats.getField("ties")
    h = (12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - ties / (n * n * n - n))
    return sums.select("dimension", "groups", h.alias("h"))


def kruskal_test(rows: DataFrame, value: str, categories: list[str]) -> DataFrame:
    """Kruskal-Wallis with upper-tail p and significance marks."""
    tested = kruskal(rows, value, categories).withColumn("p", chi2_upper("h", F.col("groups") - 1))
    return tested.withColumn("mark", stars(F.col("p"), SIGNIFICANCE, "n.s.", below=True))


def mann_whitney(rows: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """Two-sided Mann-Whitney U of the first group, with ties and continuity correction."""
    two = rows.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(value, group)
    counts = two.groupBy(value).agg(
        F.count("*").alias("ties"),
        F.count_if(F.col(group) == first).alias("m1"),
        F.sum(F.when(F.col(group) == first, F.col(value))).alias("sum1"),
        F.sum(F.when(F.col(group) == second, F.col(value))).alias("sum2"),
    )
    ran = running_counts(counts, [], value, {"before": "ties"})
    t = F.col("ties").cast("double")
    rank = F.col("before") + (t + 1) / 2
    sums = ran.agg(
        F.sum(rank * F.col("m1")).alias("r1"),
        F.sum("m1").cast("double").alias("n1"),
        F.sum("ties").cast("double").alias("n"),
        F.sum(t * t * t - t).alias("tie"),
        F.sum("sum1").alias("s1"),
        F.sum("sum2").alias("s2"),
    ).withColumn("n2", F.col("n") - F.col("n1"))
    n, n1, n2 = F.col("n"), F.col("n1"), F.col("n2")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = F.greatest((F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd, F.lit(0.0))
    medians = quantile_columns(two, [value], {"median": 0.5}, [group])
    middle = medians.agg(
        F.max(F.when(F.col(group) == first, F.col("median"))).alias("median_first"),
        F.max(F.when(F.col(group) == second, F.col("median"))).alias("median_second"),
    )
    tested = sums.select(
        u.alias("u"),
        z.alias("z"),
        (F.col("s1") / n1).alias("mean_first"),
        (F.col("s2") / n2).alias("mean_second"),
    )
    p = normal_two_sided("z")
    return (
        tested.withColumn("median_first", middle.select("median_first").scalar())
        .withColumn("median_second", middle.select("median_second").scalar())
        .withColumn("p", p)
        .withColumn("significant", F.col("p") < 0.05)
    )


def least_squares(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
    )


def fitted_line(rows: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """The least-squares line on an even grid from the smallest to the largest x."""
    fit = rows.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
    )
    grid = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    return grid.select("point", at.alias("x"), (F.col("slope") * at + F.col("intercept")).alias("y"))


def scatter_bins(rows: DataFrame, x: str, y: str, x_step: float, y_step: float) -> DataFrame:
    """Point counts on a square grid: what a scatter plot shows of a large table."""
    cell = lambda c, step: F.floor(F.col(c) / step)
    return (
        rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(cell(x, x_step).alias("x_cell"), cell(y, y_step).alias("y_cell"))
        .agg(F.count("*").alias("n"))
    )
