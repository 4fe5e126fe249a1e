"""Encoders and scalers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.operators.common import as_rows, distinct_levels, one_row


def target_encoding(
    train: DataFrame,
    column: str,
    target: str,
    min_leaf: float = 20.0,
    smoothing: float = 10.0,
    method: str = "sigmoid",
) -> DataFrame:
    """(column, encoded, n): per level a blend of its mean and the overall mean.

    The level's weight is ``1 / (1 + exp(-(n - min_leaf) / smoothing))``, or
    ``n / (n + smoothing)`` with ``method='additive'``.
    """
    stats = train.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.avg(target).alias("__mean"), F.count(target).alias("n")
    )
    prior = train.agg(F.avg(target)).scalar()
    if method == "sigmoid":
        weight = 1 / (1 + F.exp(-(F.col("n") - min_leaf) / smoothing))
    elif method == "additive":
        weight = F.col("n") / (F.col("n") + smoothing)
    else:
        raise ValueError(method)
    return stats.select(column, (prior * (1 - weight) + F.col("__mean") * weight).alias("encoded"), "n")


def apply_target_encoding(
    rows: DataFrame, encoding: DataFrame, train: DataFrame, column: str, target: str, out: str
) -> DataFrame:
    """Look the encoding up; levels unseen in the training rows get the overall mean.

    The table has a row per level and may be large, so its size decides how Spark joins
    it; hot levels are split by adaptive skew handling.
    """
    prior = train.agg(F.avg(target)).scalar()
    table = encoding.select(column, F.col("encoded").alias(out))
    joined = rows.join(table, column, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), prior))


def fitted_encoding(train: DataFrame, column: str, target: str, **options) -> DataFrame:
    """``target_encoding`` as one table that can be saved: the row with level null is the overall mean."""
    overall = train.agg(F.avg(target).alias("encoded"), F.count(target).alias("n"))
    kind = train.schema[column].dataType
    return target_encoding(train, column, target, **options).unionByName(
        overall.withColumn(column, F.lit(None).cast(kind))
    )


def apply_fitted_encoding(rows: DataFrame, fitted: DataFrame, column: str, out: str) -> DataFrame:
    """Look a saved encoding up; null and unseen levels get the overall mean."""
    prior = fitted.where(F.col(column).isNull()).agg(F.max("encoded")).scalar()
    levels = fitted.where(F.col(column).isNotNull()).select(column, F.col("encoded").alias(out))
    return rows.join(levels, column, "left").withColumn(out, F.coalesce(F.col(out), prior))


def one_hot(
    rows: DataFrame, cols: list[str], drop_first: bool = True, levels: dict[str, list] | None = None
) -> DataFrame:
    """0/1 columns named ``<column>_<level>`` in sorted level order, without the first."""
    levels = levels or {}
    new: dict[str, Column] = {}
    for c in cols:
        found = levels.get(c) or distinct_levels(rows, c)
        for level in found[1:] if drop_first else found:
            new[f"{c}_{level}"] = F.coalesce((F.col(c) == level).cast("int"), F.lit(0))
    return rows.withColumns(new).drop(*cols)


def standardise(rows: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Centre and scale by the population std of the fitted rows; a constant column stays centred."""
    fitted = rows if fit_on is None else fit_on
    stats = one_row(
        fitted,
        **{f"m{i}": F.avg(c) for i, c in enumerate(cols)},
        **{f"s{i}": F.stddev_pop(c) for i, c in enumerate(cols)},
    )
    # One column holds the statistics, so the subquery stands in the plan once.
    scaled = {}
    for i, c in enumerate(cols):
        std = F.col(f"__fit.s{i}")
        scale = F.when(std == 0, 1.0).otherwise(std)
        scaled[c] = (F.col(c) - F.col(f"__fit.m{i}")) / scale
    return rows.withColumn("__fit", stats).withColumns(scaled).drop("__fit")


def scaler_numbers(rows: DataFrame, cols: list[str]) -> list[tuple]:
    """What ``standardise`` fits, as (mean, std) of each column, for rows that are scaled many times."""
    stats = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    found = rows.agg(*stats, *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [(found[f"m{i}"], found[f"s{i}"]) for i in range(len(cols))]


def scale(rows: DataFrame, cols: list[str], numbers: list[tuple]) -> DataFrame:
    """Centre and scale by numbers; a constant column stays centred."""
    number = lambda v: F.lit(v).cast("double")
    return rows.withColumns(
        {c: (F.col(c) - number(mean)) / number(1.0 if std == 0 else std) for c, (mean, std) in zip(cols, numbers)}
    )


def fitted_scaler(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mean, std): what ``standardise`` fits, as a table that can be saved."""
    records = [{"column": F.lit(c), "mean": F.col(f"m{i}"), "std": F.col(f"s{i}")} for i, c in enumerate(cols)]
    stats = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    stats += [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]
    return as_rows(rows.agg(*stats), records)


def apply_fitted_scaler(rows: DataFrame, fitted: DataFrame, cols: list[str]) -> DataFrame:
    """Centre and scale by a saved table; a constant column stays centred."""
    of = lambda c, what: F.max(F.when(F.col("column") == c, F.col(what)))
    stats = one_row(
        fitted,
        **{f"m{i}": of(c, "mean") for i, c in enumerate(cols)},
        **{f"s{i}": of(c, "std") for i, c in enumerate(cols)},
    )
    scaled = {}
    for i, c in enumerate(cols):
        std = F.col(f"__fit.s{i}")
        scaled[c] = (F.col(c) - F.col(f"__fit.m{i}")) / F.when(std == 0, 1.0).otherwise(std)
    return rows.withColumn("__fit", stats).withColumns(scaled).drop("__fit")


def z_score(rows: DataFrame, column: str, out: str, fit_on: DataFrame | None = None) -> DataFrame:
    """(value - mean) / sample std."""
    stats = one_row(rows if fit_on is None else fit_on, m=F.avg(column), s=F.stddev_samp(column))
    return rows.withColumn(out, F.try_divide(F.col(column) - stats.getField("m"), stats.getField("s")))


def min_max(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Scale each column to [0, 1]; a constant column becomes 0."""
    ends = one_row(
        rows,
        **{f"lo{i}": F.min(c) for i, c in enumerate(cols)},
        **{f"hi{i}": F.max(c) for i, c in enumerate(cols)},
    )
    scaled = {}
    for i, c in enumerate(cols):
        lo, hi = ends.getField(f"lo{i}"), ends.getField(f"hi{i}")
        scaled[c] = F.when(hi == lo, 0.0).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return rows.withColumns(scaled)


def fill_missing(rows: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    """Nulls and NaN become a number; flags are numbers too."""
    kinds = dict(rows.dtypes)
    new = {}
    for c in cols:
        if kinds[c] in ("double", "float"):
            new[c] = F.coalesce(F.nanvl(F.col(c), F.lit(None).cast(kinds[c])), F.lit(value))
        elif kinds[c] == "boolean":
            new[c] = F.coalesce(F.col(c).cast("int"), F.lit(int(value)))
        else:
            new[c] = F.coalesce(F.col(c), F.lit(value).cast(kinds[c]))
    return rows.withColumns(new)
