"""SimHash near-duplicates with a Gray-order hierarchical index, and linked components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.llm.common import byte_table, plain_strings, quoted, settled, slices, text_of, without, words_of

SHINGLE = 3
SEED = 42
BATCH_BYTES = 4 << 20

#: A fingerprint of 64 bits has this many blocks; two that differ in fewer bits than blocks agree
#: in one block, so each link is found under the value of a block.
BLOCKS = 4
MOST_BITS = BLOCKS - 1

#: Fingerprints of one part of a hot block value; the parts meet two by two.
PART_ROWS = 20_000

#: Children of an upper node of the index.
FAN_OUT = 16


def fingerprints(texts: pa.Array) -> np.ndarray:
    """64-bit SimHash of the 3-word shingles of each text (repeats included)."""
    words, starts = words_of(texts, byte_table())
    counts = np.diff(starts)
    parts = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(parts)])
    hashes = np.zeros(begins[-1], np.uint64)
    long = np.flatnonzero(counts >= SHINGLE)
    if len(long):
        owner = np.repeat(long, parts[long])
        at = np.arange(len(owner)) - np.repeat(np.cumsum(parts[long]) - parts[long], parts[long])
        first = pa.array(starts[owner] + at)
        joined = pc.binary_join_element_wise(
            *[words.take(pc.add(first, i)) for i in range(SHINGLE)], " "
        )
        hashes[begins[owner] + at] = _hashes(joined)
    for row in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        whole = " ".join(words.slice(starts[row], counts[row]).to_pylist())
        hashes[begins[row]] = xxhash.xxh64_intdigest(whole.encode(), SEED)
    found = np.zeros(len(texts), np.uint64)
    votes = np.zeros((64, len(texts)), np.int64)
    for bit in range(64):
        ones = (hashes >> np.uint64(bit)) & np.uint64(1)
        total = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
        votes[bit] = total[begins[1:]] - total[begins[:-1]]
        found |= (votes[bit] * 2 > parts).astype(np.uint64) << np.uint64(bit)
    return found


def _hashes(shingles: pa.Array) -> np.ndarray:
    coded = shingles.cast(pa.binary()).to_pylist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in coded), np.uint64, len(coded))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", BATCH_BYTES):
            found = fingerprints(plain_strings(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(found.view(np.int64))], names=["id", "fingerprint"]
            )


def gray_rank(fingerprints: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in Gray order: neighbours in this order differ in few bits."""
    rank = fingerprints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits all their members share.

    ``levels[0]`` are the fingerprints; a node of the next level covers ``FAN_OUT`` nodes:
    ``mask`` marks the bits on which all members agree, ``bits`` their values.
    """

    def __init__(self, fingerprints: np.ndarray):
        self.order = np.argsort(gray_rank(fingerprints), kind="stable")
        bits = fingerprints[self.order]
        self.levels = [(bits, np.full(len(bits), ~np.uint64(0)))]
        while len(bits) > FAN_OUT:
            bits, mask = self.levels[-1]
            cuts = np.arange(0, len(bits), FAN_OUT)
            same = np.bitwise_and.reduceat(mask, cuts)
            ones = np.bitwise_and.reduceat(bits, cuts)
            zeros = np.bitwise_or.reduceat(bits, cuts)
            same &= ~(ones ^ zeros)
            bits = ones & same
            self.levels.append((bits, same))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes one level down, and which of ``nodes`` each belongs to."""
        low = nodes * FAN_OUT
        size = np.minimum(low + FAN_OUT, len(self.levels[level - 1][0])) - low
        owner = np.repeat(np.arange(len(nodes)), size)
        return low[owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner], owner


class Forest:
    """Union-find over places, the smallest place as root."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            root = self.roots()
            a, b = root[a], root[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root
            self.root = up


def link_near(
    left: GrayIndex, right: GrayIndex, shift: int, forest: Forest, most_bits: int = MOST_BITS,
    batch: int = 1 << 17,
) -> None:
    """Link places of ``left`` and of ``right`` (moved by ``shift``) within ``most_bits``.

    Pairs of nodes go down both trees. The bits on which both nodes are fixed and differ are a
    lower bound of the distance, so a pair of groups beyond the limit ends at its upper nodes.
    A pair of groups that the forest has joined already ends too, so a dense group costs about
    its size. Without ``shift`` both indexes are one, and each pair is looked at once.
    """

    def joined(index: GrayIndex, at: int) -> list[np.ndarray]:
        """The root that all members of each node share, -1 if they differ, by level."""
        low = high = forest.roots()[at : at + len(index.levels[0][0])]
        out = [low]
        for _ in index.levels[1:]:
            cuts = np.arange(0, len(low), FAN_OUT)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append(np.where(low == high, low, -1))
        return out

    a_top, b_top = len(left.levels) - 1, len(right.levels) - 1
    a = np.repeat(np.arange(len(left.levels[a_top][0])), len(right.levels[b_top][0]))
    b = np.tile(np.arange(len(right.levels[b_top][0])), len(left.levels[a_top][0]))
    roots = joined(left, 0), joined(right, shift)
    stack = [(a_top, b_top, a, b)]
    while stack:
        a_level, b_level, a, b = stack.pop()
        if not shift and a_level == b_level:
            a, b = a[a <= b], b[a <= b]
        if len(a) > batch:
            for cut in reversed(range(0, len(a), batch)):
                stack.append((a_level, b_level, a[cut : cut + batch], b[cut : cut + batch]))
            continue
        a_bits, a_mask = (x[a] for x in left.levels[a_level])
        b_bits, b_mask = (x[b] for x in right.levels[b_level])
        go = np.bitwise_count((a_bits ^ b_bits) & a_mask & b_mask) <= most_bits
        a_root, b_root = roots[0][a_level][a], roots[1][b_level][b]
        go &= (a_root != b_root) | (a_root < 0)
        a, b = a[go], b[go]
        if not len(a):
            continue
        if a_level == 0 and b_level == 0:
            forest.link(a, b + shift)
            roots = joined(left, 0), joined(right, shift)
        elif a_level >= b_level:
            down, owner = left.children(a_level, a)
            stack.append((a_level - 1, b_level, down, b[owner]))
        else:
            down, owner = right.children(b_level, b)
            stack.append((a_level, b_level - 1, a[owner], down))


def linked(one: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) of a forest that connects what lies within the limit.

    With ``other``, links between the two sets (and not inside them) are looked for.
    """
    left = GrayIndex(one)
    values = left.levels[0][0]
    if other is None:
        forest = Forest(len(values))
        near = np.flatnonzero(np.bitwise_count(values[1:] ^ values[:-1]) <= MOST_BITS)
        forest.link(near, near + 1)  # neighbours in Gray order
        link_near(left, left, 0, forest)
    else:
        right, shift = GrayIndex(other), len(values)
        values = np.concatenate([values, right.levels[0][0]])
        forest = Forest(len(values))
        if shift and len(other):
            link_near(left, right, shift, forest)
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(len(values)))
    return values[moved], values[roots[moved]]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, value, one, two, part, fingerprint), sorted: one group after the other."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        group = pa.Table.from_batches(rows)
        part = group.column("part").to_numpy()
        values = group.column("fingerprint").to_numpy().view(np.uint64)
        one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
        split = (values[part == one], values[part == two]) if one != two else (values,)
        a, b = linked(*split)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
        )

    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy() for n in ("block", "value", "one", "two")]
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            name = tuple(int(k[low]) for k in keys)
            if last is not None and name != last:
                yield solve(waiting)
                waiting = []
            waiting.append(batch.slice(low, high - low))
            last = name
    if waiting:
        yield solve(waiting)


def link_edges(distinct: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within three bits; one row for each at most
    in each group, never all pairs.

    Fingerprints meet under each of their four 16-bit blocks. A block value with more than
    ``part_rows`` fingerprints is dealt into parts that meet two by two, each pair in its own
    group, so no group holds more than two parts.
    """
    width = 64 // BLOCKS
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    value = F.expr(f"shiftrightunsigned(fingerprint, block * {width}) & {2**width - 1}L")
    rows = distinct.select("fingerprint", block.alias("block")).withColumn("value", value)
    counts = rows.groupBy("block", "value").count().where("count > 1")
    parts = F.ceil(F.col("count") / part_rows).cast("int")
    rows = rows.join(counts.withColumn("parts", parts).drop("count"), ["block", "value"])
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", own)
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(F.least(p, F.col("part")).alias("one"), F.greatest(p, F.col("part")).alias("two")),
    )
    rows = rows.select("block", "value", "part", "fingerprint", F.inline(others))
    keys = ["block", "value", "one", "two"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_link_batches, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes with an edge; the root is the smallest node reachable.

    Large-star and small-star rounds (each node hands its larger, then its smaller neighbours to
    the smallest one) until nothing changes; each round is a table in the shared folder.
    """

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        """``pairs`` has a > b; each a's (or every node's) neighbours move to the smallest."""
        seen = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else pairs
        least = seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = seen.join(least, "a")
        if both:
            return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        turned = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        return turned.unionByName(own)

    def clean(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").distinct()

    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = settled(clean(pairs), "links")
    before = state(pairs)
    while before[0]:
        pairs = settled(clean(star(clean(star(pairs, True)), False)), "links")
        now = state(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS
) -> DataFrame:
    """Rows (id, fingerprint, component_id) for every document.

    The fingerprint is a signed long with the 64 bits: a bit is set if it is set in over half of
    the XXH64 hashes (seed 42) of the text's 3-word shingles. Shorter texts are one shingle of
    all words. Fingerprints link at three or fewer differing bits; ``component_id`` is the
    smallest id reachable. Equal fingerprints are counted as one before the search, so copies
    cost nothing there.

    Null and empty texts have fingerprint zero and link like any other. Null ids have no part in
    ``component_id``, which is null if a component has no id. Repeated rows stay, each with its
    component. An empty table gives an empty table.
    """
    plain = docs.select(quoted(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint long"
    own = settled(plain.mapInArrow(_fingerprint_batches, schema), "fingerprints")
    distinct = own.groupBy("fingerprint").agg(F.min("id").alias("least"))
    distinct = settled(distinct, "distinct-fingerprints")
    roots = components(link_edges(distinct.select("fingerprint"), part_rows))
    rooted = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left")
    rooted = rooted.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return own.join(named, "fingerprint").select("id", "fingerprint", "component_id")


def hex_of(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component: one id of each group stays.

    Rows without id stay. Rows that share the id that stays all stay if in one component.
    """
    groups = near_groups(docs, id_col, text_col)
    dropped = groups.where(F.col("id") != F.col("component_id")).select("id")
    kept = groups.where(F.col("id") == F.col("component_id")).select("id")
    return without(docs, id_col, settled(dropped.join(kept, "id", "left_anti").distinct(), "dropped"))
