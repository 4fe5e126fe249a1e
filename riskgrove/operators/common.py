"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATS = (T.DoubleType, T.FloatType)


def is_missing(field: T.StructField) -> Column:
    """Null, or NaN for floating columns."""
    col = F.col(field.name)
    return col.isNull() | F.isnan(col) if isinstance(field.dataType, FLOATS) else col.isNull()


def one_row(rows: DataFrame, **aggregates: Column) -> Column:
    """Aggregates over a whole table as a struct usable in another query (a scalar subquery)."""
    return rows.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("s")).scalar()


def as_rows(wide: DataFrame, records: list[dict[str, Column]]) -> DataFrame:
    """One output row per record for each input row; used on one-row aggregates."""
    structs = [F.struct(*[c.alias(n) for n, c in record.items()]) for record in records]
    return wide.select(F.inline(F.array(*structs)))


def level_table(rows: DataFrame, levels: list, name: str) -> DataFrame:
    """A level dimension: (name, rank)."""
    return rows.sparkSession.createDataFrame(
        [(label, i) for i, label in enumerate(levels)], f"{name} string, rank int"
    )


def distinct_levels(rows: DataFrame, column: str, max_levels: int = 1000) -> list:
    """Sorted distinct values of a low-cardinality column."""
    found = (
        rows.select(column)
        .where(F.col(column).isNotNull())
        .distinct()
        .limit(max_levels + 1)
        .collect()
    )
    if len(found) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    return sorted(r[0] for r in found)
