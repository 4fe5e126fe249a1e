"""Reproducible stratified splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskgrove.operators.ranks import running_before, small_side
from riskgrove.operators.select import hash_order

#: Rows that one cell of digest prefixes should hold on average.
ROWS_PER_CELL = 20_000


def _cell_digits(rows: int) -> int:
    """Hex digits of a digest prefix whose cells hold about ``ROWS_PER_CELL`` rows."""
    digits = 1
    while 16**digits * ROWS_PER_CELL < rows:
        digits += 1
    return digits


def cut_offs(rows: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """(``__label``, ``__cut``): digest and key of the row at place ``round(share * n)`` of every
    class, in the order of the digest; null if no row stands there.

    Cells of digest prefixes are counted; only the one cell of each class that holds the place is
    put in order.
    """
    hashed = rows.select(F.col(label).alias("__label"), F.col(key).alias("__key"), hash_order(key, seed).alias("__hash"))
    hashed = hashed.withColumn("__cell", F.substring("__hash", 1, _cell_digits(rows.count())))
    group = W.partitionBy("__label")
    before = group.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = hashed.groupBy("__label", "__cell").agg(F.count("*").alias("__n")).select(
        "*",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.round(F.sum("__n").over(group) * share).cast("long").alias("__place"),
    )
    here = (F.col("__before") <= F.col("__place")) & (F.col("__place") < F.col("__before") + F.col("__n"))
    held = cells.where(here).select(F.col("__label").alias("__of"), F.col("__cell").alias("__in"), "__before", "__place")
    # A row for each class: only rows of those cells move.
    near = hashed.join(small_side(held), F.col("__label").eqNullSafe(F.col("__of")) & (F.col("__cell") == F.col("__in")))
    place = F.row_number().over(group.orderBy("__hash", "__key")) - 1 + F.col("__before")
    found = near.withColumn("__at", place).where("__at = __place")
    return cells.groupBy("__label").agg(F.max("__place").alias("__place")).alias("c").join(
        found.alias("f"), F.col("c.__label").eqNullSafe(F.col("f.__label")), "left"
    ).select("c.__label", F.when(F.col("f.__at").isNotNull(), F.struct("f.__hash", "f.__key")).alias("__cut"), "c.__place")


def stratified_split(
    rows: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split``: exactly ``round(test_share * n)`` rows of every class are 'test'.

    Keys are distinct. Rows are compared with the cut of their class where they are: only the
    table of cuts, a row for each class, meets them. A null label is a class of its own.
    """
    cuts = small_side(cut_offs(rows, label, key, test_share, seed))
    placed = rows.join(cuts, F.col(label).eqNullSafe(F.col("__label")))
    mine = F.struct(hash_order(key, seed).alias("__hash"), F.col(key).alias("__key"))
    test = F.col("__cut").isNull() | (mine < F.col("__cut"))
    return placed.withColumn("split", F.when(test, "test").otherwise("train")).drop(*cuts.columns)


def stratified_folds(rows: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1; class sizes of any two folds differ by at most one.

    Classes are few and huge, so positions come from counts of cells, not from one window over a
    class; the number of cells follows the number of rows. Rows without a label get no fold and
    are left out.
    """
    hashed = rows.withColumn("__hash", hash_order(key, seed)).withColumn(
        "__prefix", F.substring("__hash", 1, _cell_digits(rows.count()))
    )
    placed = running_before(
        hashed, [label], "__prefix", [F.col("__hash"), F.col(key)], {"__place": F.lit(1)}
    )
    return placed.withColumn("fold", F.pmod(F.col("__place"), F.lit(k)).cast("int")).drop(
        "__hash", "__place", "__place_all"
    )
