"""Itemset and rule queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from riskgrove.catalog.registry import over_jobs, r, register, rounded, sql_cut, sql_lookup
from riskgrove.operators import rules as R
from riskgrove.sources import schema as S
from riskgrove.sources.tables import jobs

MIN_SUPPORT = 0.05
MAX_LENGTH = 4

_INPUTS = [
    "industry",
    "risk",
    "salary",
    "experience",
    "remote",
    "diversity",
    "job_status",
    "ai_impact",
    "education",
]

# The nine transaction columns; twins group by every set of up to four of them.
_ITEM_SQL = {
    "industry": "industry",
    "risk_level": sql_cut("risk", S.RISK_EDGES, S.RISK_ITEMS),
    "salary_level": sql_cut("salary", S.SALARY_EDGES, S.SALARY_ITEMS),
    "exp_level": sql_cut("experience", S.EXPERIENCE_EDGES, S.EXPERIENCE_ITEMS),
    "remote_level": sql_cut("remote", S.REMOTE_EDGES, S.REMOTE_ITEMS),
    "diversity_level": sql_cut("diversity", S.DIVERSITY_EDGES, S.DIVERSITY_ITEMS),
    "growth_trend": sql_lookup("job_status", S.GROWTH_ITEMS),
    "ai_item": sql_lookup("ai_impact", S.IMPACT_ITEMS),
    "education": "education",
}
_LEVELED = (
    ", leveled AS (SELECT row_id, "
    + ", ".join(f"coalesce({sql}, 'nan') AS {name}" for name, sql in _ITEM_SQL.items())
    + " FROM jobs)"
)
_BASKETS = (
    _LEVELED
    + f", baskets AS (SELECT row_id, list_sort(list_distinct([{', '.join(_ITEM_SQL)}])) AS items FROM leveled)"
)
_SETS = ", ".join(
    "(" + ", ".join(chosen) + ")"
    for size in range(1, MAX_LENGTH + 1)
    for chosen in combinations(_ITEM_SQL, size)
)
ITEMSETS = (
    _LEVELED
    + f""", grouped AS MATERIALIZED (SELECT list_sort(list_filter([{', '.join(_ITEM_SQL)}], lambda x: x IS NOT NULL)) AS items,
        count(*) AS n FROM leveled GROUP BY GROUPING SETS ({_SETS})),
    total AS (SELECT count(*) AS total FROM leveled),
    itemsets AS MATERIALIZED (SELECT items, len(items) AS length, n, n * 1e0 / total AS support FROM grouped, total
                 WHERE n * 1e0 / total >= {MIN_SUPPORT}e0 AND len(items) = len(list_distinct(items)))"""
)
RULES = (
    ITEMSETS
    + """, halves AS MATERIALIZED (SELECT s.items, s.support, a.items AS antecedents, a.support AS antecedent_support
        FROM itemsets s JOIN itemsets a ON len(a.items) < len(s.items) AND list_has_all(s.items, a.items)),
    pairs AS (SELECT h.*, c.items AS consequents, c.support AS consequent_support
        FROM halves h JOIN itemsets c ON len(c.items) = len(h.items) - len(h.antecedents)
             AND list_has_all(h.items, c.items) AND NOT list_has_any(h.antecedents, c.items)),
    lev AS (SELECT *, support / antecedent_support AS confidence,
        support / (antecedent_support * consequent_support) AS lift,
        support - antecedent_support * consequent_support AS leverage FROM pairs),
    rules AS MATERIALIZED (SELECT *, 1e0 AS representativity,
        CASE WHEN confidence >= 1 THEN CAST('inf' AS DOUBLE) ELSE (1 - consequent_support) / (1 - confidence) END AS conviction,
        CASE WHEN greatest(support * (1 - antecedent_support), antecedent_support * (consequent_support - support)) = 0 THEN 0e0
             ELSE leverage / greatest(support * (1 - antecedent_support), antecedent_support * (consequent_support - support)) END
             AS zhangs_metric,
        support / (antecedent_support + consequent_support - support) AS jaccard,
        (confidence - consequent_support) / (1 - consequent_support) AS certainty,
        (support / antecedent_support + support / consequent_support) / 2 AS kulczynski,
        array_to_string(antecedents, ', ') AS antecedents_str, array_to_string(consequents, ', ') AS consequents_str
        FROM lev WHERE confidence >= 0.3e0) """
)
_ORDER = "ORDER BY rules.lift DESC, antecedents_str, consequents_str"
_TEXT = "antecedents_str, consequents_str"
_SHORT = f"{_TEXT}, {r('support')} AS support, {r('confidence')} AS confidence, {r('lift')} AS lift"
_HIGH = "(list_contains(antecedents, 'Risk_High') OR list_contains(consequents, 'Risk_High'))"
_PREDICTIVE = (
    "len(list_filter(antecedents, lambda x: contains(x, 'Risk'))) = 0 AND list_contains(consequents, 'Risk_High')"
)


def _baskets(spark, sf_dir, *keep):
    names = list(dict.fromkeys([*keep, *_INPUTS]))
    return R.transactions(jobs(spark, sf_dir, *names, heavy=True), list(keep))


def _itemsets(spark, sf_dir):
    return R.frequent_itemsets(_baskets(spark, sf_dir), MIN_SUPPORT, MAX_LENGTH)


def _rules(spark, sf_dir):
    return R.association_rules(_itemsets(spark, sf_dir), 0.3)


def _short(rules):
    return rounded(rules.select("antecedents_str", "consequents_str", "support", "confidence", "lift"))


@register(
    "r01_transactions",
    over_jobs(_BASKETS + " SELECT row_id, array_to_string(items, ', ') AS items, len(items) AS n_items FROM baskets"),
)
def transactions(spark, sf_dir):
    return _baskets(spark, sf_dir, "row_id").select(
        "row_id", R.item_text("items").alias("items"), F.size("items").cast("long").alias("n_items")
    )


@register(
    "r02_item_rows",
    over_jobs(
        _BASKETS
        + """, long AS (SELECT row_id, unnest(items) AS item FROM baskets)
        SELECT item, count(*) AS n, min(row_id) AS first_row FROM long GROUP BY item"""
    ),
)
def item_rows(spark, sf_dir):
    long = R.item_rows(_baskets(spark, sf_dir, "row_id"), "row_id")
    return long.groupBy("item").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


_ITEMS_OUT = f"array_to_string(items, ', ') AS items, length, n, {r('support')} AS support"


def _itemsets_out(itemsets):
    return rounded(
        itemsets.select(
            R.item_text("items").alias("items"), F.col("length").cast("long").alias("length"), "n", "support"
        )
    )


@register("r03_frequent_itemsets", over_jobs(ITEMSETS + f" SELECT {_ITEMS_OUT} FROM itemsets"))
def frequent_itemsets(spark, sf_dir):
    return _itemsets_out(_itemsets(spark, sf_dir))


@register("r04_length_counts", over_jobs(ITEMSETS + " SELECT length, count(*) AS n FROM itemsets GROUP BY length"))
def length_counts(spark, sf_dir):
    counts = _itemsets(spark, sf_dir).groupBy("length").agg(F.count("*").alias("n"))
    return counts.withColumn("length", F.col("length").cast("long"))


@register("f06_itemsets_of_two", over_jobs(ITEMSETS + f" SELECT {_ITEMS_OUT} FROM itemsets WHERE length = 2"))
def itemsets_of_two(spark, sf_dir):
    return _itemsets_out(_itemsets(spark, sf_dir).where(F.size("items") == 2))


@register(
    "o06_top_itemsets",
    over_jobs(ITEMSETS + f" SELECT {_ITEMS_OUT} FROM itemsets ORDER BY itemsets.support DESC, 1 LIMIT 20"),
)
def top_itemsets(spark, sf_dir):
    found = _itemsets(spark, sf_dir).orderBy(F.desc("support"), R.item_text("items")).limit(20)
    return _itemsets_out(found)


@register("r05_rules", over_jobs(RULES + f"SELECT {_SHORT} FROM rules"))
def rules(spark, sf_dir):
    return _short(_rules(spark, sf_dir))


@register(
    "r06_rule_metrics",
    over_jobs(RULES + f"SELECT {_TEXT}, {', '.join(f'{r(m)} AS {m}' for m in R.METRICS)} FROM rules"),
)
def rule_metrics(spark, sf_dir):
    return rounded(_rules(spark, sf_dir).drop("antecedents", "consequents"))


@register("r07_rule_text", over_jobs(RULES + f"SELECT {_TEXT} FROM rules"))
def rule_text(spark, sf_dir):
    return _rules(spark, sf_dir).select("antecedents_str", "consequents_str")


@register(
    "j07_support_join",
    over_jobs(
        RULES
        + f"""SELECT {_TEXT}, {r('support')} AS support, {r('antecedent_support')} AS antecedent_support,
              {r('consequent_support')} AS consequent_support FROM rules"""
    ),
)
def support_join(spark, sf_dir):
    return rounded(
        _rules(spark, sf_dir).select(
            "antecedents_str", "consequents_str", "support", "antecedent_support", "consequent_support"
        )
    )


@register("f07_high_risk_rules", over_jobs(RULES + f"SELECT {_SHORT} FROM rules WHERE {_HIGH}"))
def rules_with_high_risk(spark, sf_dir):
    return _short(R.involving(_rules(spark, sf_dir)))


@register("r08_high_risk_by_lift", over_jobs(RULES + f"SELECT {_SHORT} FROM rules WHERE {_HIGH} {_ORDER} LIMIT 15"))
def high_risk_by_lift(spark, sf_dir):
    return _short(R.by_lift(R.involving(_rules(spark, sf_dir)), 15))


@register("r09_scatter_all", over_jobs(RULES + f"SELECT {r('support')} AS support, {r('confidence')} AS confidence, {r('lift')} AS lift FROM rules"))
def scatter_all(spark, sf_dir):
    return rounded(_rules(spark, sf_dir).select("support", "confidence", "lift"))


@register("r09_scatter_top", over_jobs(RULES + f"SELECT {_SHORT} FROM rules WHERE {_HIGH} {_ORDER} LIMIT 20"))
def scatter_top(spark, sf_dir):
    return _short(R.by_lift(R.involving(_rules(spark, sf_dir)), 20))


@register(
    "f08_one_to_one",
    over_jobs(RULES + f"SELECT {_SHORT} FROM rules WHERE len(antecedents) = 1 AND len(consequents) = 1"),
)
def one_to_one(spark, sf_dir):
    return _short(R.one_to_one(_rules(spark, sf_dir)))


_TABLE_LEVELS = [*S.RISK_ITEMS, "Growth_Inc", "Growth_Dec"]


def _lift_sql(where: str) -> str:
    cells = ", ".join(
        r(f"coalesce(avg(CASE WHEN consequents_str = '{x}' THEN lift END), 0e0)") + f' AS "{x}"' for x in _TABLE_LEVELS
    )
    return over_jobs(
        RULES
        + f"""SELECT antecedents_str AS antecedent, {cells} FROM rules
        WHERE len(antecedents) = 1 AND len(consequents) = 1 AND {where} GROUP BY antecedents_str"""
    )


@register("a14_lift_table", _lift_sql("true"))
def lift_table(spark, sf_dir):
    return rounded(R.lift_table(_rules(spark, sf_dir), _TABLE_LEVELS))


@register("r10_high_risk_lift_table", _lift_sql(_HIGH))
def high_risk_lift_table(spark, sf_dir):
    return rounded(R.lift_table(R.involving(_rules(spark, sf_dir)), _TABLE_LEVELS))


@register("f09_predictive_rules", over_jobs(RULES + f"SELECT {_SHORT} FROM rules WHERE {_PREDICTIVE}"))
def predictive_rules(spark, sf_dir):
    return _short(R.predictive(_rules(spark, sf_dir)))


@register("r11_predictive_by_lift", over_jobs(RULES + f"SELECT {_SHORT} FROM rules WHERE {_PREDICTIVE} {_ORDER} LIMIT 10"))
def predictive_by_lift(spark, sf_dir):
    return _short(R.by_lift(R.predictive(_rules(spark, sf_dir)), 10))


@register("o07_top_rules", over_jobs(RULES + f"SELECT {_SHORT} FROM rules {_ORDER} LIMIT 10"))
def top_rules(spark, sf_dir):
    return _short(R.by_lift(_rules(spark, sf_dir), 10))
