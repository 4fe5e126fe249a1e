"""Left-open, right-closed binning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.operators.ranks import exact_quantiles


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cut(col: Column | str, edges: list, labels: list, include_lowest: bool = False) -> Column:
    """The label of the bin ``(lo, hi]`` that holds the value; null outside all bins."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    value = as_column(col)
    out = None
    for i, (lo, hi, label) in enumerate(zip(edges, edges[1:], labels)):
        above = value >= lo if include_lowest and i == 0 else value > lo
        test = above & (value <= hi)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def quantile_edges(rows: DataFrame, column: str, q: int) -> list[float]:
    """The ``q + 1`` exact, interpolated quantile edges of a column."""
    probs = [i / q for i in range(q + 1)]
    found = {
        round(r["p"], 12): r["q"] for r in exact_quantiles(rows, [column], probs).collect()
    }
    return [found[round(p, 12)] for p in probs]


def qcut(rows: DataFrame, column: str, q: int, labels: list, out: str) -> DataFrame:
    """Equal-frequency bins; the lowest value belongs to the first bin."""
    edges = quantile_edges(rows, column, q)
    if any(math.isclose(a, b, rel_tol=0, abs_tol=0) for a, b in zip(edges, edges[1:])):
        raise ValueError(f"bin edges of {column} are not unique: {edges}")
    return rows.withColumn(out, cut(column, edges, labels, include_lowest=True))
