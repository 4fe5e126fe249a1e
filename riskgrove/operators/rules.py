"""Frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.functions.columns import item_columns
from riskgrove.session import shared_path
from riskgrove.sources import schema as S

METRICS = [
    "antecedent_support",
    "consequent_support",
    "support",
    "confidence",
    "lift",
    "representativity",
    "leverage",
    "conviction",
    "zhangs_metric",
    "jaccard",
    "certainty",
    "kulczynski",
]


def transactions(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The sorted distinct items of each row; a value outside its bins is the item ``nan``."""
    leveled = rows.withColumns(item_columns())
    items = F.array(
        *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in S.TRANSACTION_COLUMNS]
    )
    return leveled.select(*(keep or []), F.array_sort(F.array_distinct(items)).alias("items"))


def item_rows(baskets: DataFrame, key: str) -> DataFrame:
    """(key, item): the long form of the item matrix."""
    return baskets.select(key, F.explode("items").alias("item"))


def _chosen(items: str, mask: str) -> Column:
    return F.filter(
        F.col(items), lambda x, i: F.col(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0
    )


def frequent_itemsets(
    baskets: DataFrame, min_support: float = 0.05, max_length: int = 4
) -> DataFrame:
    """(items, length, n, support) of every itemset with at least the minimum support.

    Equal baskets are counted once and keep the numbers of their frequent items only. Each level
    joins the frequent sets with the baskets that hold them, extends them by later items of the
    basket and sums the basket counts per extension; partial sums leave only the extensions to
    shuffle. A level is a table in the shared folder, which also settles the numbers of its sets:
    Spark sees the size of the table and broadcasts it only if small.
    """
    counted = baskets.groupBy("items").agg(F.count("*").alias("w")).persist()
    opened = counted.select("items", "w", F.explode(F.array_distinct("items")).alias("item"))
    total = counted.agg(F.sum("w")).first()[0] or 0
    enough = lambda sums: sums.where(F.col("n") / F.lit(float(total)) >= min_support)
    number = F.monotonically_increasing_id()  # grows with the item, as the rows are in its order
    singles = enough(opened.groupBy("item").agg(F.sum("w").alias("n"))).orderBy("item")
    singles = _stored(singles.withColumn("last", number), "items")
    known = opened.join(singles.select("item", "last"), "item").groupBy("items")
    inside = known.agg(F.array_sort(F.collect_list("last")).alias("basket"), F.first("w").alias("w")).persist()
    levels = [singles.select(F.col("last").alias("id"), F.array("item").alias("items"), "n")]
    grown = inside.select("basket", "w", F.explode("basket").alias("id"))
    grown = grown.withColumn("last", F.col("id"))
    while len(levels) < max_length and not levels[-1].isEmpty():
        later = F.explode(F.filter("basket", lambda x: x > F.col("before"))).alias("last")
        grown = grown.withColumnsRenamed({"id": "prefix", "last": "before"})
        grown = grown.select("basket", "w", "prefix", later)
        sums = enough(grown.groupBy("prefix", "last").agg(F.sum("w").alias("n")))
        longer = F.concat("items", F.array("item")).alias("items")
        named = sums.join(levels[-1].select(F.col("id").alias("prefix"), "items"), "prefix")
        named = named.join(singles.select("last", "item"), "last")
        level = _stored(named.select(number.alias("id"), "prefix", "last", longer, "n"), "itemsets")
        levels.append(level)
        grown = grown.join(level.select("prefix", "last", "id"), ["prefix", "last"])
        grown = grown.select("basket", "w", "id", "last")
    counted.unpersist()
    inside.unpersist()
    found = levels[0].select("items", "n")
    for level in levels[1:]:
        found = found.unionByName(level.select("items", "n"))
    return found.select(
        "items", F.size("items").alias("length"), "n", (F.col("n") / F.lit(float(total))).alias("support")
    )


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def association_rules(itemsets: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """Every split of an itemset into antecedents and consequents, with ten measures."""
    known = itemsets.select("items", "support")
    full = F.call_function("shiftleft", F.lit(1), F.size("items")) - 1
    splits = (
        known.where(F.size("items") > 1)
        .select("items", "support", full.alias("full"), F.explode(F.sequence(F.lit(1), full - 1)).alias("mask"))
        .withColumn("rest", F.col("full") - F.col("mask"))
        .select(
            _chosen("items", "mask").alias("antecedents"),
            _chosen("items", "rest").alias("consequents"),
            "support",
        )
    )
    left = known.select(
        F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support")
    )
    right = known.select(
        F.col("items").alias("consequents"), F.col("support").alias("consequent_support")
    )
    joined = splits.join(left, "antecedents").join(right, "consequents")
    return (
        with_metrics(joined)
        .where(F.col("confidence") >= min_confidence)
        .select(
            "antecedents",
            "consequents",
            *METRICS,
            item_text("antecedents").alias("antecedents_str"),
            item_text("consequents").alias("consequents_str"),
        )
    )


def item_text(items: str) -> Column:
    return F.array_join(F.array_sort(F.col(items)), ", ")


def with_metrics(splits: DataFrame) -> DataFrame:
    """The ten measures from the three supports."""
    s, a, c = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    confidence = F.try_divide(s, a)
    leverage = s - a * c
    bound = F.greatest(s * (1 - a), a * (c - s))
    return splits.withColumns(
        {
            "confidence": confidence,
            "lift": F.try_divide(s, a * c),
            "representativity": F.lit(1.0),
            "leverage": leverage,
            "conviction": F.when(confidence >= 1, F.lit(float("inf"))).otherwise(
                F.try_divide(1 - c, 1 - confidence)
            ),
            "zhangs_metric": F.coalesce(F.try_divide(leverage, bound), F.lit(0.0)),
            "jaccard": F.try_divide(s, a + c - s),
            "certainty": F.coalesce(F.try_divide(confidence - c, 1 - c), F.lit(0.0)),
            "kulczynski": (F.try_divide(s, a) + F.try_divide(s, c)) / 2,
        }
    )


def by_lift(rules: DataFrame, n: int | None = None) -> DataFrame:
    ordered = rules.orderBy(F.desc("lift"), "antecedents_str", "consequents_str")
    return ordered if n is None else ordered.limit(n)


def involving(rules: DataFrame, item: str = "Risk_High") -> DataFrame:
    """Rules with the item on either side."""
    return rules.where(F.array_contains("antecedents", item) | F.array_contains("consequents", item))


def one_to_one(rules: DataFrame) -> DataFrame:
    return rules.where((F.size("antecedents") == 1) & (F.size("consequents") == 1))


def predictive(rules: DataFrame, item: str = "Risk_High", family: str = "Risk") -> DataFrame:
    """Rules that lead to the item from items outside its family."""
    inside = F.exists("antecedents", lambda x: x.contains(family))
    return rules.where(~inside & F.array_contains("consequents", item))


def lift_table(rules: DataFrame, levels: list[str]) -> DataFrame:
    """Mean lift of one-to-one rules, antecedents down and consequents across, 0 if absent."""
    pairs = one_to_one(rules).select(
        F.element_at("antecedents", 1).alias("antecedent"),
        F.element_at("consequents", 1).alias("consequent"),
        "lift",
    )
    return pairs.groupBy("antecedent").pivot("consequent", levels).agg(F.avg("lift")).fillna(0.0)
