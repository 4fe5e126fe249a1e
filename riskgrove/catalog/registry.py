"""The registry of queries and the SQL pieces their twins share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskgrove.sources import schema as S
from riskgrove.sources.tables import JOBS_SQL


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) function under a name."""

    def keep(build):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build

    return keep


def _nudge(digits: int) -> float:
    """Far below the last digit kept, far above the noise of summation order.

    A mean that ends in an exact half of the last digit would otherwise round by its noise.
    """
    return float(f"3.3e-{digits + 2}")


def settled(value: Column | str, digits: int = 6) -> Column:
    """Round one column so that the order of summation cannot show."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col + F.lit(_nudge(digits)), digits)


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Settle every double column."""
    return rows.select(
        *[
            settled(f"`{c}`", digits).alias(c) if kind == "double" else F.col(f"`{c}`")
            for c, kind in rows.dtypes
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    """SQL twin of ``settled`` (adding zero turns -0 into 0)."""
    return f"(round({expression} + {_nudge(digits)!r}, {digits}) + 0e0)"


def over_jobs(body: str) -> str:
    """A SQL query over the analysis table; ``body`` may open with further CTEs (', x AS ...')."""
    return f"WITH jobs AS ({JOBS_SQL}) {body}"


def sql_text(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def sql_number(value: float) -> str:
    if value == float("inf"):
        return "CAST('inf' AS DOUBLE)"
    if value == -float("inf"):
        return "CAST('-inf' AS DOUBLE)"
    return f"{float(value)!r}" if "e" in repr(float(value)) else f"{float(value)!r}e0"


def sql_cut(expression: str, edges: list, labels: list) -> str:
    """CASE twin of ``cut``."""
    quoted = [sql_text(x) if isinstance(x, str) else str(x) for x in labels]
    arms = " ".join(
        f"WHEN {expression} > {sql_number(lo)} AND {expression} <= {sql_number(hi)} THEN {label}"
        for lo, hi, label in zip(edges, edges[1:], quoted)
    )
    return f"CASE {arms} END"


def sql_lookup(expression: str, mapping: dict) -> str:
    """CASE twin of ``lookup``."""
    lit = lambda v: sql_text(v) if isinstance(v, str) else str(v)
    return (
        "CASE " + " ".join(f"WHEN {expression} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"
    )


def sql_long(cols: list[str], extra: str = "", source: str = "jobs", cast: str = "DOUBLE") -> str:
    """UNION ALL twin of an unpivot into (extra, column, value)."""
    head = f"{extra}, " if extra else ""
    return " UNION ALL ".join(
        f"SELECT {head}'{c}' AS \"column\", CAST({c} AS {cast}) AS value FROM {source}" for c in cols
    )


def sql_levels(levels: list[str], name: str = "level") -> str:
    return "(VALUES " + ", ".join(f"({sql_text(x)}, {i})" for i, x in enumerate(levels)) + f") lv({name}, rank)"


GROWTH_SQL = "((openings_future - openings_now) * 1e0 / openings_now)"
RISK_SQL = sql_cut("risk", S.RISK_EDGES, S.RISK_NAMES)
RISK_CODE_SQL = sql_cut("risk", S.RISK_EDGES, S.RISK_CODES)
