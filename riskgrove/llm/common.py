"""Helpers shared by the operators of this subpackage.

Rows travel as one struct column (``boxed``), so columns of the caller never clash with
columns of an operator. Cuts of the lineage are tables in the shared folder (``settled``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.session import shared_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Java and RE2 pattern of a word between white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of a membership filter: one megabyte, whatever the size of the tables.
FILTER_BITS = 1 << 23
_BITMAP_BITS = 32_768  # of one built-in bitmap


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def boxed(rows: DataFrame, **more: Column) -> DataFrame:
    """Columns ``more`` beside the whole row as the struct ``row``."""
    every = F.struct(*[quoted(c).alias(c) for c in rows.columns])
    return rows.select(every.alias("row"), *[c.alias(n) for n, c in more.items()])


def unboxed(rows: DataFrame, *more: str) -> DataFrame:
    """The rows of ``boxed`` again; ``more`` replaces columns of the same name."""
    taken = {m.lower() for m in more}
    names = [f.name for f in rows.schema["row"].dataType.fields if f.name.lower() not in taken]
    return rows.select(*[F.col("row").getField(n).alias(n) for n in names], *more)


def settled(rows: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it survives lost executors."""
    spark = rows.sparkSession
    path = shared_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def membership(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> Column:
    """A filter of fixed size over the column ``key``, as a scalar subquery for ``may_hold``.

    It has no false negatives; it only saves work, so a full filter costs time and no result.
    """
    at = F.pmod(F.xxhash64(key), F.lit(bits)).cast("long")
    maps = keys.groupBy(F.floor(at / _BITMAP_BITS).cast("int").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("m")
    )
    return maps.agg(F.map_from_entries(F.collect_list(F.struct("b", "m")))).scalar()


def may_hold(members: Column, key: Column, bits: int = FILTER_BITS) -> Column:
    """Whether the filter may hold a key; never null."""
    at = F.pmod(F.xxhash64(key), F.lit(bits)).cast("long")
    of = F.try_element_at(members, F.floor(at / _BITMAP_BITS).cast("int"))
    place = F.bitmap_bit_position(at + 1)
    byte = F.conv(F.hex(F.substring(of, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("int"), (place % 8).cast("int")) == 1, F.lit(False))


def without(rows: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """Rows whose id is not in the one-column table ``dropped``; a null id stays.

    Rows that the filter clears pass where they are; only the others are shuffled.
    """
    key = dropped.columns[0]
    dropped = dropped.where(quoted(key).isNotNull()).select(quoted(key).alias("gone"))
    held = may_hold(membership(dropped, "gone"), quoted(id_col))
    aside = boxed(rows, id=quoted(id_col), held=held)
    clear = aside.where(~F.col("held"))
    rest = aside.where("held").join(dropped, F.col("id") == F.col("gone"), "left_anti")
    return unboxed(clear.unionByName(rest))


# ---- Arrow batches -------------------------------------------------------------------------


def byte_table(word: str = "between white space") -> np.ndarray:
    """Maps each UTF-8 byte: A-Z to a-z, bytes outside words to a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    if word == "alphanumeric":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text
        for low, high in ((0, 47), (58, 64), (91, 96), (123, 127)):
            table[low : high + 1] = 32
    else:  # [^\x20\x09-\x0D]+
        table[9:14] = 32
    return table


def plain_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with 32-bit offsets, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Replace every byte of the texts by its entry of the table (ASCII bytes only change)."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0 or ends[-1] == ends[0]:
        return pa.array([""] * len(texts), pa.string())
    new = table[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    return pa.StringArray.from_buffers(
        len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(new)
    )


def words_of(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words begin (one more than texts)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(mapped(texts, table)))
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    if len(ends):
        ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # an empty text gives one empty word
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        flat = flat.filter(pa.array(full))
    return flat, ends


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most_bytes`` of text; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most_bytes, "right")))
        yield batch.slice(start, end - start)
        start = end


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each segment; ``starts`` has one more entry than segments, empty ones allowed."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]
