"""Derived columns, lookups and level codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskgrove.functions.binning import as_column, cut
from riskgrove.sources import schema as S


def ratio(top: Column, bottom: Column) -> Column:
    """IEEE division: x/0 is a signed infinity, 0/0 is null."""
    inf = F.lit(float("inf"))
    return (
        F.when((bottom == 0) & (top > 0), inf)
        .when((bottom == 0) & (top < 0), -inf)
        .otherwise(F.try_divide(top.cast("double"), bottom.cast("double")))
    )


def lookup(col: Column | str, mapping: dict) -> Column:
    """A dictionary lookup; unknown keys give null."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), as_column(col))


def ordinal(col: Column | str, order: list[str]) -> Column:
    """The position of a label in its order; null for an unknown label."""
    return lookup(col, {label: code for code, label in enumerate(order)})


def education_code(col: Column | str = "education", apostrophe: str = "normal") -> Column:
    """Ordinal education. ``apostrophe='strict'`` knows the ASCII spelling only.

    The published preparation step is strict, so labels spelled with U+2019 get no code.
    """
    if apostrophe not in ("normal", "strict"):
        raise ValueError(apostrophe)
    ascii_order = [label.replace("’", "'") for label in S.EDUCATION_ORDER]
    value = as_column(col)
    if apostrophe == "normal":
        value = F.translate(value, "’", "'")
    return ordinal(value, ascii_order)


def growth_rate() -> Column:
    return ratio(F.col("openings_future") - F.col("openings_now"), F.col("openings_now"))


def interactions() -> dict[str, Column]:
    """The interaction features other than the z-score, by name."""
    growth = growth_rate()
    years = F.col("experience") + 1
    impact = lookup("ai_impact", {label: i + 1 for i, label in enumerate(S.IMPACT_ORDER)})
    return {
        "growth_rate": growth,
        "salary_per_experience": F.try_divide(F.col("salary"), years),
        "job_density": F.try_divide(F.col("openings_now"), years),
        "salary_remote_interaction": F.col("salary") * F.col("remote") / 100,
        "growth_impact_interaction": growth * impact,
        "salary_experience_interaction": F.col("salary") * F.col("experience"),
        "diversity_growth_interaction": F.col("diversity") * growth,
        "remote_growth_interaction": F.col("remote") * growth,
    }


def levels() -> dict[str, Column]:
    """The four binned levels, by name."""
    return {
        "experience_level": cut("experience", S.EXPERIENCE_EDGES, S.EXPERIENCE_LEVELS),
        "salary_level": cut("salary", S.SALARY_EDGES, S.SALARY_LEVELS),
        "remote_level": cut("remote", S.REMOTE_EDGES, S.REMOTE_LEVELS),
        "growth_category": cut(growth_rate(), S.GROWTH_EDGES, S.GROWTH_LEVELS),
    }


def codes(apostrophe: str = "normal") -> dict[str, Column]:
    """The seven ordinal codes, by name."""
    level = levels()
    return {
        "education_encoded": education_code("education", apostrophe),
        "impact_encoded": ordinal("ai_impact", S.IMPACT_ORDER),
        "status_encoded": ordinal("job_status", S.STATUS_ORDER),
        "experience_level_encoded": ordinal(level["experience_level"], S.EXPERIENCE_LEVELS),
        "salary_level_encoded": ordinal(level["salary_level"], S.SALARY_LEVELS),
        "remote_level_encoded": ordinal(level["remote_level"], S.REMOTE_LEVELS),
        "growth_category_encoded": ordinal(level["growth_category"], S.GROWTH_LEVELS),
    }


def stars(value: Column, limits: list[tuple[float, str]], other: str, below: bool) -> Column:
    """Significance marks: the first limit the value passes."""
    out = None
    for limit, mark in limits:
        test = value < limit if below else value > limit
        out = F.when(test, mark) if out is None else out.when(test, mark)
    return out.otherwise(other)


def item_columns() -> dict[str, Column]:
    """The seven derived transaction columns, by name."""
    return {
        "risk_level": cut("risk", S.RISK_EDGES, S.RISK_ITEMS),
        "salary_level": cut("salary", S.SALARY_EDGES, S.SALARY_ITEMS),
        "exp_level": cut("experience", S.EXPERIENCE_EDGES, S.EXPERIENCE_ITEMS),
        "remote_level": cut("remote", S.REMOTE_EDGES, S.REMOTE_ITEMS),
        "diversity_level": cut("diversity", S.DIVERSITY_EDGES, S.DIVERSITY_ITEMS),
        "growth_trend": lookup("job_status", S.GROWTH_ITEMS),
        "ai_item": lookup("ai_impact", S.IMPACT_ITEMS),
    }
