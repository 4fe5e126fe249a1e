"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from riskgrove.llm.common import lowered, may_hold, membership, quoted, settled, text_of, unboxed

#: Characters of a text that the second step hashes.
PREFIX_CHARS = 256

#: Columns that ``exact_groups`` adds.
FOUND = ("keep_id", "group_size", "kept", "text_hash")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_hash`` (binary SHA-256).

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
    largest id is kept. A length, or a hash of length and prefix, that occurs once ends a row's
    search: its full text is not hashed and ``text_hash`` is null. Steps count ids, lengths and
    hashes only; rows (the columns in ``carry``, by default all) are shuffled only where a full
    hash may repeat, and one row for each group meets them, so a hot group can be split.

    Null text counts as empty, so empty and null texts are one group. A null id is smaller than
    any id; if all ids of a group are null, ``keep_id`` is null. Rows that share text and id are
    a tie: one of them is kept, the one whose carried columns hash lowest. An empty table gives
    an empty table. Columns of ``docs`` named like the four new ones are replaced.
    """
    low = lowered(text_of(text_col))
    size = F.octet_length(text_of(text_col))
    start = F.xxhash64(size, lowered(F.substring(text_of(text_col), 1, prefix_chars)))
    full = F.unhex(F.sha2(low, 256))

    sizes = docs.select(size.alias("size")).groupBy("size").count().where("count > 1")
    same_size = may_hold(membership(sizes, "size"), size)
    starts = docs.where(same_size).select(start.alias("start")).groupBy("start").count()
    same_start = same_size & may_hold(membership(starts.where("count > 1"), "start"), start)
    hashed = docs.where(same_start).select(start.alias("start"), full.alias("hash"), quoted(id_col).alias("id"))
    by_id = settled(hashed.groupBy("start", "hash", "id").agg(F.count("*").alias("rows")), "exact")

    best = F.max_by(F.struct("id", "rows"), F.struct("id")).alias("best")
    groups = by_id.groupBy("start", "hash").agg(F.sum("rows").alias("group_size"), best)
    groups = groups.where("group_size > 1")
    ties = groups.where("best.rows > 1")

    row = F.struct(*[quoted(c).alias(c) for c in carry or docs.columns]).alias("row")
    again = may_hold(membership(groups, "start"), start)
    tied = may_hold(membership(ties, "start"), start)
    rows = docs.select(row, quoted(id_col).alias("id"), start.alias("at"), full.alias("text_hash"), again.alias("again"))
    columns = ["row", *FOUND]

    single = rows.where(~F.col("again")).select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lit(None).cast("binary").alias("text_hash"),
    )

    def shared(part: DataFrame) -> DataFrame:
        groups_ = groups.drop("start")
        joined = part.join(groups_, F.col("text_hash") == F.col("hash"), "left")
        alone = F.col("hash").isNull()
        return joined.withColumns(
            {
                "keep_id": F.when(alone, F.col("id")).otherwise(F.col("best.id")),
                "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
                "kept": alone | F.col("id").eqNullSafe(F.col("best.id")),
            }
        )

    if ties.isEmpty():
        every = single.unionByName(shared(rows.where("again")).select(columns))
        return unboxed(every, *FOUND)
    rows = docs.select(
        row, quoted(id_col).alias("id"), start.alias("at"), full.alias("text_hash"),
        again.alias("again"), tied.alias("tied"),
    )
    order = Window.partitionBy("text_hash", "id").orderBy(F.xxhash64("row"))
    first = shared(rows.where("again AND tied")).withColumn(
        "kept", F.col("kept") & (F.row_number().over(order) == 1)
    )
    rest = shared(rows.where("again AND NOT tied"))
    every = single.unionByName(rest.select(columns)).unionByName(first.select(columns))
    return unboxed(every, *FOUND)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``exact_groups`` with the columns of ``docs``."""
    apart = docs.select(
        F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row"),
        quoted(id_col).alias("id"),
        quoted(text_col).alias("text"),
    )
    return exact_groups(apart, "id", "text", carry=["row"]).where("kept").select("row.*")
