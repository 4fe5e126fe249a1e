"""Benchmark decontamination with an FM-index for each shard of the training texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskgrove.llm.common import (
    byte_table, plain_strings, quoted, settled, slices, text_of, words_of,
)
from riskgrove.llm.fmindex import FMIndex, ranges

WINDOW = 10

#: Text of one shard, and benchmark text that one pass searches for.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20

#: Symbols: 0 ends a shard, 1 stands between runs of words, benchmark words follow.
BETWEEN, FIRST_WORD = 1, 2

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
            ),
            False,
        ),
        T.StructField("items", T.ArrayType(T.StringType()), False),
    ]
)
FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


class Phrases:
    """The windows of one block of benchmark items: word symbols, phrases and their items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(names)}
        flat, starts = words_of(pa.array([text for _, text in items], pa.string()), byte_table("alphanumeric"))
        words = flat.to_pylist()
        self.names = names
        self.symbol: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for row, (name, _) in enumerate(items):
            own = [
                self.symbol.setdefault(w, FIRST_WORD + len(self.symbol))
                for w in words[starts[row] : starts[row + 1]]
            ]
            for at in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[at : at + window]), set()).add(place[name])
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.phrases = np.zeros((len(owners), window), np.int64)
        for row, phrase in enumerate(owners):
            self.phrases[row, : len(phrase)] = phrase
        own = [sorted(x) for x in owners.values()]
        self.own_starts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        self.own = np.array([y for x in own for y in x], np.int64)
        self.shortest = int(self.lengths.min()) if len(owners) else 0


def find(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Search one shard: words of each text, and (text, first word, phrase) of every occurrence.

    Words that no item holds can't be in an occurrence, nor can a run of known words that is
    shorter than the shortest phrase: the index covers the other runs, parted by a symbol.
    """
    words, starts = words_of(texts, byte_table("alphanumeric"))
    nothing = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(words):
        return np.diff(starts), nothing, nothing, nothing
    coded = words.dictionary_encode()
    codes = np.array([phrases.symbol.get(w, 0) for w in coded.dictionary.to_pylist()], np.int64)
    symbols = codes[coded.indices.to_numpy()]
    border = symbols == 0
    edge = np.ones(len(symbols) + 1, bool)  # where a run begins or the word before ends one
    edge[1:-1] = border[1:] | border[:-1]
    edge[starts] = True
    begin = np.flatnonzero(edge)
    begin, size = begin[:-1], np.diff(begin)
    long = (size >= phrases.shortest) & ~border[begin]
    begin, size = begin[long], size[long]
    if not len(begin):
        return np.diff(starts), nothing, nothing, nothing
    at, _ = ranges(begin, begin + size)
    shift = np.cumsum(size + 1) - (size + 1)  # place of each run in the shard
    shard = np.full(int((size + 1).sum()), BETWEEN, np.int64)
    to, _ = ranges(shift, shift + size)
    shard[to] = symbols[at]
    index = FMIndex(shard)
    low, high = index.search(phrases.phrases, phrases.lengths)
    rows, phrase = ranges(low, high)
    place = index.locate(rows)
    run = np.searchsorted(shift, place, "right") - 1
    word = begin[run] + place - shift[run]
    text = np.searchsorted(starts, word, "right") - 1
    return np.diff(starts), text, word - starts[text], phrase


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans that touch or overlap."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], start[1:] > end[:-1]])
    return start[first], end[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(end) - 1]])]


def _pass(batches: Iterator[pa.RecordBatch], block, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    phrases: Phrases = block.value
    for batch in batches:
        for part in slices(batch, "text", shard_bytes):
            n_words, text, word, phrase = find(plain_strings(part.column("text")), phrases)
            old = part.column("found").to_pylist()
            spans = [[(s["start"], s["end"]) for s in o["spans"]] if o else [] for o in old]
            items = [set(o["items"]) if o else set() for o in old]
            order = np.argsort(text, kind="stable")
            text, word, phrase = text[order], word[order], phrase[order]
            for row in np.unique(text):
                here = slice(*np.searchsorted(text, [row, row + 1]))
                start, end = word[here], word[here] + phrases.lengths[phrase[here]]
                known = np.array(spans[row], np.int64).reshape(-1, 2)
                start, end = merged(
                    np.concatenate([start, known[:, 0]]), np.concatenate([end, known[:, 1]])
                )
                spans[row] = list(zip(start.tolist(), end.tolist()))
                used = np.unique(phrase[here])
                own, _ = ranges(phrases.own_starts[used], phrases.own_starts[used + 1])
                items[row] |= {phrases.names[i] for i in np.unique(phrases.own[own])}
            found = pa.array(
                [
                    {
                        "n_words": int(n),
                        "spans": [{"start": a, "end": b} for a, b in s],
                        "items": sorted(i),
                    }
                    for n, s, i in zip(n_words, spans, items)
                ],
                FOUND_ARROW,
            )
            columns = [found if n == "found" else part.column(n) for n in part.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``row`` (the whole row) and ``found``: n_words, spans and items.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A phrase
    is ``window`` consecutive words of an item, or all words of a shorter item. ``spans`` are the
    merged word ranges [start, end) of all occurrences, ``items`` the ids (as text, sorted) of
    items with an occurring phrase.

    Each task cuts its texts into shards, builds an FM-index for each and searches all phrases.
    The benchmark is broadcast in blocks of about ``block_bytes`` of text: a pass over the texts
    for each block, with the results so far written to the shared folder in between.

    Null text has no words and no spans; an item with null text or without words has no phrase;
    an item with null id is named by the empty text; rows of one item id are one item. Empty
    tables give empty results or no spans.
    """
    items = benchmark.select(
        F.coalesce(quoted(item_col).cast("string"), F.lit("")).alias("name"),
        text_of(item_text_col).alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    number = F.pmod(F.xxhash64("name", "text"), F.lit(blocks))

    every = F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row")
    rows = docs.select(every, text_of(text_col).alias("text"), F.lit(None).cast(FOUND).alias("found"))
    spark = docs.sparkSession
    for block in range(blocks):
        own = [(r["name"], r["text"]) for r in items.where(number == block).collect()]
        sent = spark.sparkContext.broadcast(Phrases(sorted(own), window))
        schema = T.StructType([*rows.schema.fields[:2], T.StructField("found", FOUND)])
        rows = rows.mapInArrow(partial(_pass, block=sent, shard_bytes=shard_bytes), schema)
        if block + 1 < blocks:
            rows = settled(rows, "decontaminate")
    return rows.select("row", "found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any occurrence of a benchmark phrase."""
    clean = contamination(docs, benchmark, text_col).where(F.size("found.spans") == 0)
    return clean.select("row.*")


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            without_spans(text, [(s["start"], s["end"]) for s in spans]) if spans else text
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def cut_out(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows of ``docs``, their texts without the words of benchmark phrases; null stays null."""
    rows = contamination(docs, benchmark, text_col)
    text = F.col("row").getField(text_col).cast("string").alias("text")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    clean = rows.select("row", text, F.col("found.spans").alias("spans")).mapInArrow(_cut_batches, schema)
    own = lambda c: F.col("text") if c == text_col else F.col("row").getField(c)
    return clean.select(*[own(c).alias(c) for c in docs.columns])


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans; what stands between kept words stays."""
    import re

    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : words[start].start()])
        at = words[end - 1].end()
    return "".join(kept) + text[at:]
