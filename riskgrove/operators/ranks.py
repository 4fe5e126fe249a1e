"""Order statistics and ranks without a sort in one task.

Values are counted first, so a value shared by many rows is one row from there on. They
are then put into cells by a fixed, increasing function of the value; cells into which many
values crowd are cut by their own range. A running total is the total of the cells before plus
a running total inside the cell: the table of cells is small, and the windows inside cells are
spread over all tasks, however large one group is.
The same counted values feed both, so Spark shuffles them once and reuses the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SMALL_ROWS = 10_000
CELL = "__cell"
FINENESS = 32_768

#: Distinct values that a cell holds before it is cut into parts of about this many.
CELL_VALUES = 20_000


def small_side(small: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A join side that is expected to be small.

    It is computed once; only if it has at most ``max_rows`` rows is it marked for
    broadcast, otherwise joins with it stay ordinary equi-joins.
    """
    rows = small.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return small
    return F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))


def attach_small(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = SMALL_ROWS
) -> DataFrame:
    """Join a table that is expected to be small, broadcast only after a check of its size."""
    return big.join(small_side(small, max_rows), on, how)


def value_cell(value: Column, fineness: int = FINENESS) -> Column:
    """A whole number that never decreases as the value grows.

    Cells are even steps of the eighth root, so their width follows the size of the value.
    Square roots are exactly rounded everywhere, so all tasks agree on a value's cell.
    """
    x = value.cast("double")
    root = F.sqrt(F.sqrt(F.sqrt(F.abs(x))))
    step = F.floor(F.least(root, F.lit(1e12)) * fineness)
    return F.when(x < 0, -step - 1).otherwise(step)


def in_cells(
    counts: DataFrame, by: list[str], value: str, fineness: int = FINENESS, cell_values: int = CELL_VALUES
) -> DataFrame:
    """Add ``__cell``, which never decreases along the value; one input row per group and value.

    The first part of a cell is ``value_cell``. Cells with more than ``cell_values`` values are
    cut evenly between their least and largest value: the second part. Usually there are none,
    and adaptive execution drops the join with them.
    """
    x = F.col(value).cast("double")
    placed = counts.withColumn("__rough", value_cell(F.col(value), fineness))
    keys = [*by, "__rough"]
    ends = [F.count("*").alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi")]
    crowded = placed.groupBy(*keys).agg(*ends).where(F.col("__n") > cell_values)
    crowded = crowded.withColumn("__parts", F.ceil(F.col("__n") / cell_values)).drop("__n")
    share = F.try_divide(x - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    part = F.least(F.floor(share * F.col("__parts")), F.col("__parts") - 1)
    cell = F.struct(F.col("__rough").alias("rough"), F.coalesce(part, F.lit(0)).alias("part"))
    joined = placed.join(crowded, keys, "left")
    return joined.select(*[F.col(f"`{c}`") for c in counts.columns], cell.alias(CELL))


def running_before(
    rows: DataFrame, by: list[str], cell: str, order: list[Column], weights: dict[str, Column]
) -> DataFrame:
    """Add, per weight, its sum over the rows of the same group that come earlier.

    ``cell`` must never decrease along ``order``. Group totals are added as ``<name>_all``.
    """
    keys = [*by, cell]
    totals = rows.groupBy(*keys).agg(*[F.sum(w).alias(f"__{n}") for n, w in weights.items()])
    group = W.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}_offset") for n in weights],
        *[F.sum(f"__{n}").over(group).alias(f"{n}_all") for n in weights],
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = rows.select(
        "*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"__{n}_local") for n, w in weights.items()]
    )
    joined = local.join(offsets, keys)
    return joined.select(
        *[F.col(c) for c in rows.columns if c != cell],
        *[(F.col(f"__{n}_offset") + F.col(f"__{n}_local")).alias(n) for n in weights],
        *[F.col(f"{n}_all") for n in weights],
    )


def running_counts(
    counts: DataFrame, by: list[str], value: str, weights: dict[str, str], fineness: int = FINENESS
) -> DataFrame:
    """Running totals along a numeric value; one input row per group and value."""
    placed = in_cells(counts, by, value, fineness)
    return running_before(
        placed, by, CELL, [F.col(value)], {n: F.col(c) for n, c in weights.items()}
    )


def average_ranks(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """One row per distinct value: its count and its average-tie rank within the group."""
    by = by or []
    counts = (
        rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    )
    ran = running_counts(counts, by, value, {"before": "ties"})
    return ran.select(
        *by,
        value,
        "ties",
        (F.col("before") + (F.col("ties") + 1) / 2).alias("avg_rank"),
        F.col("before_all").alias("n"),
    )


def long_form(rows: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(group columns, column, value) with nulls and NaN left out."""
    by = by or []
    wide = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    if len(cols) == 1:
        long = wide.select(*by, F.lit(cols[0]).alias("column"), F.col(cols[0]).alias("value"))
    else:
        long = wide.unpivot(by, cols, "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def counted_values(rows: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(group columns, column, value, ties): one row per distinct value of each column."""
    by = by or []
    return (
        long_form(rows, cols, by)
        .groupBy(*by, "column", "value")
        .agg(F.count("*").alias("ties"))
    )


def quantiles_of_counts(
    counts: DataFrame, keys: list[str], probs: list[float], fineness: int = FINENESS
) -> DataFrame:
    """Exact linearly interpolated quantiles of counted values: (keys, p, q).

    Cell totals tell which cells hold the wanted ranks; only values of those few cells
    are put in order.
    """
    placed = in_cells(counts, keys, "value", fineness)
    group = W.partitionBy(*keys)
    cells = (
        placed.groupBy(*keys, CELL)
        .agg(F.sum("ties").alias("n"))
        .select(
            *keys,
            CELL,
            "n",
            F.sum("n").over(group.orderBy(CELL).rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
            F.sum("n").over(group).alias("total"),
        )
    )
    # Exploding in the same select would multiply the rows below the window.
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    located = (
        cells.withColumn("p", asked)
        .withColumn("at", (F.col("total") - 1) * F.col("p"))
        .withColumn("lo", F.floor("at"))
        .withColumn("hi", F.least(F.col("lo") + 1, F.col("total") - 1))
        .withColumn("start", F.col("upto") - F.col("n"))
    )
    holds = lambda r: (F.col("start") <= F.col(r)) & (F.col(r) < F.col("upto"))
    wanted = (
        located.where(holds("lo") | holds("hi"))
        .groupBy(*keys, CELL)
        .agg(F.collect_list(F.struct("p", "at", "lo", "hi", "start")).alias("probes"))
    )
    upto = F.sum("ties").over(
        W.partitionBy(*keys, CELL).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    )
    ordered = (
        placed.join(wanted, [*keys, CELL])
        .select(*keys, "value", "ties", "probes", upto.alias("upto"))
        .select(*keys, "value", "ties", "upto", F.inline("probes"))
    )
    last = F.col("start") + F.col("upto")
    first = last - F.col("ties")
    hit = lambda r: F.when((first <= F.col(r)) & (F.col(r) < last), F.col("value"))
    picked = ordered.groupBy(*keys, "p").agg(
        F.max(hit("lo")).alias("below"),
        F.max(hit("hi")).alias("above"),
        F.max(F.col("at") - F.col("lo")).alias("part"),
    )
    return picked.select(
        *keys, "p", (F.col("below") + (F.col("above") - F.col("below")) * F.col("part")).alias("q")
    )


def exact_quantiles(
    rows: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles: (group columns, column, p, q)."""
    by = by or []
    return quantiles_of_counts(counted_values(rows, cols, by), [*by, "column"], probs)


def named_quantiles(counts: DataFrame, keys: list[str], named: dict[str, float]) -> DataFrame:
    """Quantiles of counted values as columns, one row per group."""
    long = quantiles_of_counts(counts, keys, sorted(set(named.values())))
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(name) for name, p in named.items()]
    )


def quantile_columns(
    rows: DataFrame, cols: list[str], named: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Quantiles as columns, one row per group and column."""
    by = by or []
    return named_quantiles(counted_values(rows, cols, by), [*by, "column"], named)
