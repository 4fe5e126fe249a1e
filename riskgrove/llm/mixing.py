"""Mixing sources to target weights: hash-random order, distributed running totals, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskgrove.llm.common import boxed, quoted, settled, text_of, unboxed, word_count

#: Rows that one range of random keys should hold on average.
ROWS_PER_RANGE = 20_000

#: Largest target of a source, in times its size.
MOST_EPOCHS = 3

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """Target words of each source: rows (source, source_size) with ``target`` added.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes. No target exceeds ``most_epochs`` times its source; the excess goes to the others by
    weight until none is above. In the order of size by weight the capped sources come first, so
    the final level is the largest of (words left) / (weight left) over that order. The table has
    one row for each source of the mix and is ordered in one task.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.get(cycle, place % len(weights)))
    ratio = F.col("source_size") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    capped = F.coalesce(F.sum(F.col("source_size") * most_epochs).over(before), F.lit(0))
    passed = F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - capped) / (F.sum("weight").over(whole) - passed)
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.max("level").over(whole))
        .withColumn(
            "target",
            F.least(F.col("source_size") * F.lit(float(most_epochs)), F.col("level") * F.col("weight")),
        )
        .select("source", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target`` and ``taken`` (words the mix takes).

    The target is rounded to words. A source is taken whole as often as it fits; the rest comes
    from the front of its random order, and the document at the cut gives the words still
    missing, so each source gives its target exactly. The random key is the MD5 of the id as
    text. Leading digits of the key name a range; running totals of ranges show the range that
    holds a source's cut, and only that range is sorted to find the row. All rows are then
    compared with the cut of their source where they are: whole rows are never shuffled. The
    number of ranges follows the number of rows, so a source with a third of all rows is spread.

    Null text has size 0 and is taken 0 times. Rows without source form a source of their own.
    Equal keys (repeated or null ids) are ordered by id and size; rows alike in both at a cut
    share the missing words evenly, rounded down. A table without words has targets of 0, an
    empty table gives an empty table. Columns named like the four new ones are replaced.
    """
    own = {
        "source": quoted(source_col),
        "key": F.md5(F.coalesce(quoted(id_col).cast("string"), F.lit(""))),
        "id": quoted(id_col),
        "size": word_count(text_of(text_col)),
    }
    narrow = settled(docs.select(*[c.alias(n) for n, c in own.items()]), "mix")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) div source_size")).otherwise(0)
    goals = targets(sources, weights, most_epochs).withColumn("epochs", epochs)
    goals = settled(
        goals.withColumn("left", words - F.col("epochs") * F.col("source_size")), "mix-targets"
    )

    digits, rows = 1, narrow.count()
    while 16**digits * rows_per_range < rows:
        digits += 1
    ranged = narrow.where("size > 0").withColumn("span", F.substring("key", 1, digits))
    totals = ranged.groupBy("source", "span").agg(F.sum("size").alias("words"))
    spans = totals.withColumn("before", _before("words", "source", ["span"]))
    here = (F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words"))
    cut_spans = _of_source(spans, goals.where("left > 0")).where(here).select("source", "span", "before", "left")

    alike = ranged.groupBy("source", "span", "key", "id", "size").agg(F.count("*").alias("n"))
    near = alike.alias("r").join(
        cut_spans.alias("o"),
        F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.span") == F.col("o.span")),
    )
    near = near.select("r.source", "key", "id", "size", "n", "before", "left")
    near = near.withColumn("words", F.col("size") * F.col("n"))
    near = near.withColumn("before", F.col("before") + _before("words", "source", ["key", "id", "size"]))
    cuts = near.where(here).select(
        "source", F.struct("key", "id", "size").alias("cut"), F.expr("(left - before) div n").alias("rest")
    )
    plan = settled(_of_source(goals, cuts, "left").select("source", "source_size", "target", "epochs", "cut", "rest"), "mix-plan")

    placed = _of_source(boxed(docs, **own), plan)
    mine = F.struct("key", "id", "size")
    more = F.when(mine < F.col("cut"), F.col("size")).when(mine == F.col("cut"), F.col("rest"))
    taken = F.col("epochs") * F.col("size") + F.coalesce(more, F.lit(0))
    placed = placed.withColumn("taken", taken.cast("long"))
    return unboxed(placed, "size", "source_size", "target", "taken")


def _before(value: str, by: str, order: list[str]) -> Column:
    """Total of the rows in front of each row."""
    rows = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


def _of_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, null included."""
    table = table.withColumnRenamed("source", "source_")
    same = F.col("source").eqNullSafe(F.col("source_"))
    return rows.join(table, same, how).drop("source_")
