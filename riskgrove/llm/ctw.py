"""LM scoring by context-tree weighting over bytes.

A text is its lower-cased words with one space between them and one end byte. Each byte is eight
binary decisions; the context of a decision is the bits of the byte so far and the bytes before
it, up to ``DEPTH``. Every node of the tree (a context of some depth, and the bits so far) holds
how often training data went on with 0 and 1, a Krichevsky-Trofimov estimate, and the weighted
mix of its own estimate and that of its children; a prediction mixes the estimates of all depths
on its path. A path ends at the longest context seen in training.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.llm.common import (
    byte_table, plain_strings, quoted, segment_sums, settled, slices, text_of, words_of,
)

DEPTH = 5
END = b"\n"
BATCH_BYTES = 4 << 20

#: Bytes whose grams a task holds at once, whatever the length of a text.
PIECE = 1 << 18

#: The same where they are only counted: longer pieces leave fewer entries to sum.
COUNTED = 1 << 20

#: Entries of counts that a task gathers before it sums them.
GATHERED = 2_000_000

#: Leaves of the tree that one scoring pass broadcasts, about; the passes cover all leaves.
BLOCK_LEAVES = 4_000_000

#: Words whose counts are broadcast, at most; all other words meet their counts in a join.
FREQUENT_WORDS = 1 << 20

GRAM, WORD = 0, 1


# ---- counting ------------------------------------------------------------------------------


def _hashes(words: pa.Array) -> np.ndarray:
    values = words.cast(pa.binary()).to_pylist()
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in values), np.uint64, len(values)).view(np.int64)


END_HASH = int(np.uint64(xxhash.xxh64_intdigest(END)).view(np.int64))


def grams(
    words: pa.Array, starts: np.ndarray, depth: int, most: int = PIECE
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The key (context bytes, then the byte) of every byte of every text, in pieces of at most
    ``most`` bytes: the first text of the piece, the keys, and where the bytes of each of its texts
    begin (one more than texts). The context of a first byte is end bytes."""
    lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), words)
    tail = END.decode() * max(1, depth)
    stream = pc.binary_join_element_wise(pc.binary_join(lists, " "), tail, "")
    ends = np.frombuffer(stream.buffers()[1], np.int32)[: len(stream) + 1].astype(np.int64)
    data = np.frombuffer(stream.buffers()[2], np.uint8)[: ends[-1]]
    data = np.concatenate([np.full(depth, END[0], np.uint8), data])
    begins, stops = ends[:-1], ends[1:] - len(tail) + 1
    for low in range(0, int(ends[-1]), most):
        high = min(low + most, int(ends[-1]))
        first, last = np.searchsorted(stops, low, "right"), np.searchsorted(begins, high, "left")
        if first == last:  # nothing but end bytes between two texts
            continue
        begin = np.maximum(begins[first:last], low) - low
        stop = np.minimum(stops[first:last], high) - low
        keys = np.zeros(high - low, np.uint64)
        for j in range(depth + 1):
            np.left_shift(keys, np.uint64(8), out=keys)
            np.bitwise_or(keys, data[low + j : high + j], out=keys, casting="unsafe")
        coded = np.zeros(high - low + 1, np.int8)
        coded[begin] += 1
        coded[stop] -= 1
        real = np.cumsum(coded[:-1], dtype=np.int8).astype(bool)
        yield int(first), keys[real], np.concatenate([[0], np.cumsum(stop - begin)])


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each key, with the sum of its counts."""
    keys = np.concatenate([k for k, _ in found])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(np.concatenate([n for _, n in found])[order], first)


def _count_batches(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Counts of byte grams and of words, summed for a task as far as memory allows."""
    kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: []}
    entries = {GRAM: 0, WORD: 0}

    def add(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept[kind].append((keys, n))
        entries[kind] += len(keys)
        if entries[kind] > GATHERED:
            kept[kind] = [_summed(kept[kind])]
            entries[kind] = len(kept[kind][0][0])
            if entries[kind] > GATHERED // 2:
                yield flush(kind)

    def flush(kind: int) -> pa.RecordBatch:
        keys, n = _summed(kept[kind]) if len(kept[kind]) > 1 else kept[kind][0]
        kept[kind], entries[kind] = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)],
            names=["kind", "key", "n"],
        )

    for batch in batches:
        for part in slices(batch, "text", BATCH_BYTES):
            words, starts = words_of(plain_strings(part.column("text")), byte_table())
            for _, keys, _ in grams(words, starts, depth, COUNTED):
                yield from add(GRAM, *np.unique(keys.view(np.int64), return_counts=True))
            coded = words.dictionary_encode()
            own = _hashes(coded.dictionary)
            n = np.bincount(coded.indices.to_numpy(), minlength=len(own))
            yield from add(WORD, np.append(own, END_HASH), np.append(n, len(starts) - 1))
    for kind, found in kept.items():
        if found:
            yield flush(kind)


# ---- the tree, as tables -------------------------------------------------------------------


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0 (Stirling's series above seven)."""
    product = x
    for j in range(1, 7):
        product = product * (x + j)
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _estimate(n0: Column, n1: Column) -> Column:
    """Log probability that Krichevsky and Trofimov's estimator gives n0 zeros and n1 ones."""
    n0, n1 = n0.cast("double"), n1.cast("double")
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1)


def _parent(node: Column, depth: int) -> Column:
    """The node of the next shorter context, of ``depth`` bytes."""
    context = F.shiftright(node, 8).bitwiseAND(F.lit((1 << 8 * depth) - 1).cast("long"))
    return F.shiftleft(context, 8).bitwiseOR(node.bitwiseAND(F.lit(255).cast("long")))


def tree(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (depth, node, logit) from gram counts (key, n): the log odds of a 1 at each node when
    the path ends there. A node is the context bytes, then the bits so far behind a leading 1.

    Weights go up the tree by one aggregation for each depth, mixes come down by one join.
    """
    place = F.explode(F.sequence(F.lit(0), F.lit(7)))
    rows = counts.select("key", "n", place.alias("k"))
    prefix = F.expr("shiftright(key & 255L | 256L, 8 - k)")
    bit = F.expr("shiftright(key & 255L, 7 - k) & 1L")
    node = F.shiftleft(F.shiftright("key", 8), 8).bitwiseOR(prefix)
    rows = rows.select(node.alias("node"), (F.col("n") * (1 - bit)).alias("n0"), (F.col("n") * bit).alias("n1"))
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    levels: list[DataFrame] = []
    for d in range(depth, -1, -1):
        if d == depth:
            level = rows.groupBy("node").agg(*sums).withColumn("own", _estimate(F.col("n0"), F.col("n1")))
            level = level.withColumn("weighted", F.col("own")).withColumn("odds", F.lit(0.0))
        else:
            below = levels[-1].withColumn("node", _parent(F.col("node"), d))
            level = below.groupBy("node").agg(*sums, F.sum("weighted").alias("below"))
            level = level.withColumn("own", _estimate(F.col("n0"), F.col("n1")))
            apart = F.abs(F.col("own") - F.col("below"))
            both = F.greatest("own", "below") + F.log1p(F.exp(-apart)) - math.log(2)
            level = level.withColumn("weighted", both).withColumn("odds", F.col("own") - F.col("below"))
        levels.append(settled(level.select("node", "n0", "n1", "weighted", "odds"), f"ctw-{d}"))
    levels.reverse()

    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    done, above = [], None
    for d, level in enumerate(levels):
        if above is None:
            state = level.withColumn("mixed", F.lit(0.0)).withColumn("left", F.lit(1.0))
        else:
            up = above.select(F.col("node").alias("up"), "mixed", "left")
            state = level.withColumn("up", _parent(F.col("node"), d - 1)).join(up, "up")
        ends = F.col("mixed") + F.col("left") * estimate
        done.append(
            state.select(F.lit(d).alias("depth"), "node", F.log(ends / (1 - ends)).cast("float").alias("logit"))
        )
        stays = 1 / (1 + F.exp(-F.col("odds")))
        above = state.select(
            "node",
            (F.col("mixed") + F.col("left") * stays * estimate).alias("mixed"),
            (F.col("left") * (1 - stays)).alias("left"),
        )
    return settled(reduce(DataFrame.unionByName, done), "ctw-nodes")


# ---- scoring -------------------------------------------------------------------------------


def _log10(logit: np.ndarray, one: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0, np.where(one, -logit, logit)) / math.log(10)


def _leaf_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All deepest nodes of some contexts, in their order: the log probability of both bytes under
    seven bits. The last context of a batch waits for the next one."""
    rest = np.zeros(0, np.int64), np.zeros(0, np.float32)
    for batch in batches:
        found = batch.column("node").to_numpy(), batch.column("logit").to_numpy()
        nodes, logit = (np.concatenate(x) for x in zip(rest, found))
        cut = int(np.searchsorted(nodes >> 8, nodes[-1] >> 8)) if len(nodes) else 0
        yield _leaf_batch(nodes[:cut], logit[:cut])
        rest = nodes[cut:], logit[cut:]
    yield _leaf_batch(*rest)


def _leaf_batch(nodes: np.ndarray, logit: np.ndarray) -> pa.RecordBatch:
    logit = logit.astype(float)
    leaf = np.flatnonzero((nodes & 128) != 0)
    context, low = nodes[leaf] & ~255, nodes[leaf] & 127
    total = np.zeros(len(leaf))
    for k in range(7):
        prefix = (low | 128) >> (7 - k)
        one = ((low >> (6 - k)) & 1).astype(bool)
        total += _log10(logit[np.searchsorted(nodes, context | prefix)], one)
    keys = (context.view(np.uint64) >> np.uint64(1)).view(np.int64) | low
    zero = total + _log10(logit[leaf], np.zeros(len(leaf), bool))
    one = total + _log10(logit[leaf], np.ones(len(leaf), bool))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(zero.astype(np.float32)), pa.array(one.astype(np.float32))],
        names=["leaf", "zero", "one"],
    )


def leaves(nodes: DataFrame, depth: int) -> DataFrame:
    """Rows (leaf, zero, one): log10 probabilities of the two bytes under every deepest node with
    seven bits; ``leaf`` is the context and the bits. A task reads the contexts dealt to it in
    order, so it holds those of one batch."""
    deepest = nodes.where(F.col("depth") == depth).select("node", "logit")
    dealt = deepest.repartition(F.shiftright("node", 8)).sortWithinPartitions("node")
    return dealt.mapInArrow(_leaf_batches, "leaf long, zero float, one float")


class Leaves:
    """A block of leaves with a hash table, built where it is first used."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, mine: np.ndarray):
        self.keys, self.values, self.mine = keys, values, mine
        self.slots: np.ndarray | None = None
        self.bits = max(4, int(len(keys) * 2).bit_length())

    def _build(self) -> None:
        size = 1 << self.bits
        slots = np.full(size, -1, np.int32)
        for low in range(0, len(self.keys), PIECE):
            at = self._slot(self.keys[low : low + PIECE])
            waiting = np.arange(low, low + len(at), dtype=np.int32)
            while len(waiting):
                free = slots[at] < 0
                slots[at[free]] = waiting[free]
                rest = slots[at] != waiting
                waiting, at = waiting[rest], (at[rest] + 1) & (size - 1)
        self.slots = slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def scores(self, grams_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every gram of this block (else 0), and where a gram is unknown."""
        if self.slots is None:
            self._build()
        out = np.zeros(len(grams_))
        own = np.arange(len(grams_))
        if not self.mine.all():
            own = np.flatnonzero(self.mine[(grams_ >> np.uint64(8)) & np.uint64(0xFFFF)])
            grams_ = grams_[own]
        wanted, last = grams_ >> np.uint64(1), (grams_ & np.uint64(1)).astype(np.int64)
        at, open_ = self._slot(wanted), np.arange(len(wanted))
        missing = [np.zeros(0, np.int64)]
        while len(open_):
            found = self.slots[at]
            hit = found >= 0
            missing.append(open_[~hit])
            if len(self.keys):
                hit &= self.keys[found] == wanted[open_]
            where = open_[hit]
            out[own[where]] = self.values[found[hit], last[where]]
            more = (found >= 0) & ~hit
            open_, at = open_[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out, np.sort(own[np.concatenate(missing)])


def _score_batches(batches: Iterator[pa.RecordBatch], block, depth: int) -> Iterator[pa.RecordBatch]:
    """A row for each piece of a text with its sum over known grams, and one for each unknown gram
    in the piece."""
    table: Leaves = block.value
    for batch in batches:
        for part in slices(batch, "text", BATCH_BYTES):
            words, starts = words_of(plain_strings(part.column("text")), byte_table())
            mark = part.column("mark").to_numpy()
            for first, keys, begins in grams(words, starts, depth):
                scores, missing = table.scores(keys)
                row = np.searchsorted(begins, missing, "right") - 1
                order = np.lexsort((keys[missing], row))
                row, gram = row[order], keys[missing][order].view(np.int64)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(row)))
                texts = len(begins) - 1
                row = first + np.concatenate([np.arange(texts), row[new]])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(row)),
                        pa.array(mark[row]),
                        pa.array(np.concatenate([mark[first : first + texts], gram[new]])),
                        pa.array(np.concatenate([np.zeros(texts, np.int64), times])),
                        pa.array(np.concatenate([segment_sums(scores, begins), np.zeros(len(times))])),
                    ],
                    names=["id", "mark", "gram", "times", "score"],
                )


def backed_off(unknown: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Rows (gram, log) for grams without a leaf: each decision at its longest known context."""
    rows = unknown.select("gram").distinct()
    rows = rows.select("gram", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    rows = rows.select(
        "gram", "k", F.expr("shiftright(gram, 7 - k) & 1L = 1L").alias("one"),
        F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"),
    )
    context = F.expr("shiftright(gram, 8) & (shiftleft(1L, 8 * depth) - 1L)")
    node = F.shiftleft(context, 8).bitwiseOR(F.expr("shiftright(gram & 255L | 256L, 8 - k)"))
    met = rows.withColumn("node", node).join(nodes, ["depth", "node"], "left")
    best = F.max(F.when(F.col("logit").isNotNull(), F.struct("depth", "logit")))
    logit = F.coalesce(best["logit"], F.lit(0.0)).alias("logit")
    bits = met.groupBy("gram", "k", "one").agg(logit)
    signed = F.when(F.col("one"), -F.col("logit")).otherwise(F.col("logit"))
    log = -(F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))) / math.log(10)
    return bits.groupBy("gram").agg(F.sum(log).alias("log"))


def _token_batches(batches: Iterator[pa.RecordBatch], frequent, scale: float, ends: int) -> Iterator[pa.RecordBatch]:
    """A row for each text with the sums over frequent words, and one for each other word in it."""
    keys, counts = frequent.value
    for batch in batches:
        for part in slices(batch, "text", BATCH_BYTES):
            words, starts = words_of(plain_strings(part.column("text")), byte_table())
            coded = words.dictionary_encode()
            own, place = _hashes(coded.dictionary), coded.indices.to_numpy()
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            log = np.zeros(len(own))
            log[known] = np.log10((counts[at[known]] + 0.5) / scale)
            n = np.diff(starts)
            n_known = segment_sums(known[place].astype(np.int64), starts) + (ends > 0)
            base = segment_sums(log[place], starts) + math.log10((ends + 0.5) / scale)
            mark = part.column("mark").to_numpy()
            none = np.zeros(len(n), np.int64)
            rows = [mark, np.arange(len(n)), none, np.ones(len(n), np.int64), n + 1, n_known, base]
            rare = np.flatnonzero(~known[place])
            row = np.searchsorted(starts, rare, "right") - 1
            pair, times = np.unique(row * np.int64(max(1, len(own))) + place[rare], return_counts=True)
            row, word = pair // max(1, len(own)), pair % max(1, len(own))
            zero = np.zeros(len(pair), np.int64)
            other = [own[word], row, times, zero, zero, zero, zero.astype(float)]
            word, row, times, *sums = [np.concatenate(x) for x in zip(rows, other)]
            ids = part.column("id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(mark[row]), pa.array(word), pa.array(times), *[pa.array(s) for s in sums]],
                names=["id", "mark", "word", "times", "rows", "n_tokens", "n_known", "base_score"],
            )


def blocks_of(table: DataFrame, block_leaves: int) -> Iterator[Leaves]:
    """The leaves in blocks by the last two context bytes."""
    spark = table.sparkSession
    number = max(1, math.ceil(table.count() / block_leaves))
    last = F.shiftright("leaf", 7).bitwiseAND(F.lit(0xFFFF).cast("long"))
    at = lambda two: F.pmod(F.xxhash64(two), F.lit(number))
    pairs = spark.range(1 << 16).select("id", at(F.col("id")).alias("block")).toArrow()
    owner = np.zeros(1 << 16, np.int64)
    owner[pairs.column("id").to_numpy()] = pairs.column("block").to_numpy()
    for block in range(number):
        rows = table.where(at(last) == block).toArrow()
        values = np.stack([rows.column("zero").to_numpy(), rows.column("one").to_numpy()], axis=1)
        yield Leaves(rows.column("leaf").to_numpy().view(np.uint64), values, owner == block)


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    block_leaves: int = BLOCK_LEAVES,
    frequent_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score) for all texts.

    Training rows are those whose crc32 of the id as text leaves a remainder other than 1 by 5;
    their words and byte grams are counted in the tasks and summed by a shuffle. ``base_score``
    is the log10 probability under smoothed word counts, ``score`` that of the byte model for the
    same words and ends. Words are counted by their 64-bit hash. The counts of at most
    ``frequent_words`` words and the leaves of the tree in blocks of about ``block_leaves`` are
    broadcast. All other words meet their counts in a join, grams without a leaf meet the nodes
    of shorter contexts in another, and the sums of the blocks are added, so no count and no node
    is left out at any size.

    Null text counts as empty (one end token); a null id counts as empty text in the split. Rows
    with equal id and text have equal results, one for each. Without training rows every bit has
    probability one half and ``base_score`` is 0. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(quoted(id_col).alias("id"), text_of(text_col).alias("text"))
    train = rows.where(~held_out(F.col("id"))).select("text")
    counts = train.mapInArrow(partial(_count_batches, depth=depth), "kind int, key long, n long")
    counts = settled(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    nodes = tree(counts.where(F.col("kind") == GRAM), depth)

    words = counts.where(F.col("kind") == WORD).where("n > 0").select(F.col("key").alias("word"), "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = tokens + 0.5 * (distinct + 1)
    ends = (words.where(F.col("word") == END_HASH).first() or (0, 0))[1]
    sizes = words.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()
    least, kept = 1 << 62, 0
    for size, number in sizes:
        kept += number
        if kept > frequent_words:
            break
        least = 1 << size
    often = words.where(F.col("n") >= least).toArrow()
    keys = often.column("word").to_numpy()
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], often.column("n").to_numpy()[order]))

    marked = rows.select("id", F.xxhash64("text").alias("mark"), "text")
    schema = f"id {id_type}, mark long, word long, times long, rows long, n_tokens long, n_known long, base_score double"
    seen = partial(_token_batches, frequent=frequent, scale=scale, ends=ends)
    found = marked.mapInArrow(seen, schema).join(words, "word", "left")
    rare, n = F.col("times") > 0, F.coalesce("n", F.lit(0))
    parts = [
        found.select(
            "id", "mark", "rows", "n_tokens",
            F.when(rare & (n > 0), F.col("times")).otherwise(F.col("n_known")).alias("n_known"),
            F.when(rare, F.col("times") * F.log10((n + 0.5) / scale))
            .otherwise(F.col("base_score")).alias("base_score"),
            F.lit(0.0).alias("score"),
        )
    ]
    scored = []
    for block in blocks_of(settled(leaves(nodes, depth), "ctw-leaves"), block_leaves):
        sent = spark.sparkContext.broadcast(block)
        own = partial(_score_batches, block=sent, depth=depth)
        scored.append(marked.mapInArrow(own, f"id {id_type}, mark long, gram long, times long, score double"))
    scored = settled(reduce(DataFrame.unionByName, scored), "lm-scores")
    none = [F.lit(0).cast("long").alias(n) for n in ("rows", "n_tokens", "n_known")]
    none.append(F.lit(0.0).alias("base_score"))
    unknown = scored.where("times > 0")
    late = unknown.join(backed_off(unknown, nodes, depth), "gram")
    parts.append(scored.where("times = 0").select("id", "mark", *none, "score"))
    parts.append(late.select("id", "mark", *none, (F.col("times") * F.col("log")).alias("score")))
    names = ["rows", "n_tokens", "n_known", "base_score", "score"]
    sums = reduce(DataFrame.unionByName, parts).groupBy("id", "mark").agg(*[F.sum(n).alias(n) for n in names])
    each = [(F.col(n) / F.col("rows")).cast(kind).alias(n) for n, kind in zip(names[1:], ("long", "long", "double", "double"))]
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return sums.select("id", *each, copies).select(
        "id", held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 by 5 (null id: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 1
