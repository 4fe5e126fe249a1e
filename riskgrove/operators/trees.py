"""Histogram trees on a binned matrix, grown by Spark jobs.

Rows are binned once and packed into blocks. Nodes with many rows get the histograms of all their
features from one pass over the blocks, for all trees at once, and the histograms of the blocks are
summed. As soon as the rows of a node fit one task, they are shuffled there and the task finishes
the subtree, so a tree of any depth takes a few jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a block, and rows of a node that one task may hold.
BLOCK_ROWS = 65_536
LOCAL_ROWS = 500_000

#: Partial histograms are summed on executors beyond this many.
PARTIALS = 32

#: Cells of histograms that are looked at together.
CELLS = 1 << 22


# ---- binning -------------------------------------------------------------------------------


def edges_of(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of at most ``bins`` bins of about equal size for each feature; one aggregation."""
    shares = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    cuts = rows.agg(
        *[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 20_000).alias(f"c{i}") for i, c in enumerate(features)],
        *[F.max(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(features)],
    ).first()
    out = []
    for i in range(len(features)):
        edges = np.unique(np.array(cuts[f"c{i}"] or [], float))
        out.append(edges[edges < cuts[f"m{i}"]] if cuts[f"m{i}"] is not None else edges)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers (row, feature): bin b holds values above edge b - 1 and up to edge b."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


def mixed(numbers: np.ndarray, salt: int) -> np.ndarray:
    """Unsigned 64-bit hashes of numbers under a salt, the same in every task."""
    with np.errstate(over="ignore"):
        z = numbers.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shares_of(numbers: np.ndarray, salt: int) -> np.ndarray:
    """Hashes as evenly spread numbers from 0 to 1."""
    return mixed(numbers, salt).astype(np.float64) / 2.0**64


def blocks_of(
    rows: DataFrame, features: list[str], edges: list[np.ndarray], label: str, tag: str, key: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(x, y, tag, h, n): bins, labels, tags and hashes of the keys of up to ``block_rows`` rows."""
    flat = rows.select(
        F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x"),
        F.col(label).cast("int").alias("y"),
        F.col(tag).cast("int").alias("tag"),
        F.xxhash64(key).alias("h"),
    )
    wide = len(features)

    def pack(parts):
        x = np.concatenate([p[0] for p in parts])
        y, t, h = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        for a in range(0, len(y), block_rows):
            b = slice(a, a + block_rows)
            yield pa.RecordBatch.from_pydict(
                {"x": [x[b].tobytes()], "y": [y[b].tobytes()], "tag": [t[b].tobytes()], "h": [h[b].tobytes()], "n": [len(y[b])]}
            )

    def go(batches):
        parts, held = [], 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
            column = lambda c, kind: batch.column(c).to_numpy(zero_copy_only=False).astype(kind)
            parts.append((binned(x, edges), column("y", np.int8), column("tag", np.int8), column("h", np.int64)))
            held += batch.num_rows
            if held >= block_rows:
                yield from pack(parts)
                parts, held = [], 0
        if parts:
            yield from pack(parts)

    return flat.mapInArrow(go, "x binary, y binary, tag binary, h binary, n long")


def of_block(batch: pa.RecordBatch, r: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c, kind: np.frombuffer(batch.column(c)[r].as_py(), kind)
    return get("x", np.uint8).reshape(-1, wide), get("y", np.int8), get("tag", np.int8), get("h", np.int64).view(np.uint64)


# ---- splits --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """How nodes are scored. ``boost`` has channels (gradient, hessian, rows); otherwise a channel
    for each class with its weight."""

    boost: bool
    bins: int
    depth: int
    min_child: float
    min_split: float = 2.0
    min_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    leaves: int = 0  # 0: as many as the depth allows

    def size(self, c: np.ndarray) -> np.ndarray:
        return c[..., 2] if self.boost else c.sum(axis=-1)

    def score(self, c: np.ndarray) -> np.ndarray:
        if self.boost:
            g = np.maximum(np.abs(c[..., 0]) - self.l1, 0.0)
            return g * g / (c[..., 1] + self.l2 + 1e-12)
        n = c.sum(axis=-1)
        return (c * c).sum(axis=-1) / np.maximum(n, 1e-12)

    def value(self, c: np.ndarray) -> np.ndarray:
        """Leaf outputs (node, output): a step against the gradient, or class shares."""
        if self.boost:
            g = np.sign(c[..., 0]) * np.maximum(np.abs(c[..., 0]) - self.l1, 0.0)
            return (-g / (c[..., 1] + self.l2 + 1e-12))[..., None]
        return c / np.maximum(c.sum(axis=-1, keepdims=True), 1e-12)

    def best(self, hist: np.ndarray, total: np.ndarray):
        """(gain, slot, bin, channels of the left child) of each node; a gain of 0 means no split."""
        left = np.cumsum(hist, axis=2)
        right = total[:, None, None, :] - left
        gain = self.score(left) + self.score(right) - self.score(total)[:, None, None]
        fits = (self.size(left) >= self.min_child) & (self.size(right) >= self.min_child)
        if self.boost:
            fits &= (left[..., 1] >= self.min_hessian) & (right[..., 1] >= self.min_hessian)
        gain = np.where(fits, gain, 0.0).reshape(len(hist), -1)
        at = gain.argmax(axis=1)
        slot, b = np.divmod(at, hist.shape[2])
        rows = np.arange(len(hist))
        found = gain[rows, at]
        found[(self.size(total) < self.min_split) | (found <= 1e-10)] = 0.0
        return found, slot, b, left[rows, slot, b]


@dataclass(frozen=True)
class Columns:
    """The features a tree may split on: a share for the tree, or a number for each node."""

    wide: int
    share: float = 1.0
    per_node: int = 0

    def of_nodes(self, salt: int, ids: np.ndarray) -> np.ndarray:
        """(node, slot) feature numbers; drawn by hashes, so every task draws the same."""
        every = np.arange(self.wide)
        if self.per_node:
            draw = mixed(ids.astype(np.uint64)[:, None] * np.uint64(self.wide) + every.astype(np.uint64), salt)
            return np.sort(np.argsort(draw, axis=1, kind="stable")[:, : self.per_node], axis=1)
        count = max(1, round(self.share * self.wide))
        own = np.sort(np.argsort(mixed(every, salt), kind="stable")[:count])
        return np.broadcast_to(own, (len(ids), count))


def histograms(x: np.ndarray, c: np.ndarray, node: np.ndarray, nodes: int, feats: np.ndarray, bins: int, shared: bool) -> np.ndarray:
    """(node, slot, bin, channel) sums of rows; ``feats`` are the features of each node's slots."""
    slots, channels = feats.shape[1], c.shape[1]
    out = np.empty((nodes, slots, bins, channels))
    base = node * bins
    for s in range(slots):
        cell = base + (x[:, feats[0, s]] if shared else x[np.arange(len(x)), feats[node, s]])
        for k in range(channels):
            out[:, s, :, k] = np.bincount(cell, weights=c[:, k], minlength=nodes * bins).reshape(nodes, bins)
    return out


@dataclass
class Grown:
    """Nodes by heap number: a split has a feature, a leaf has -1."""

    ids: list = field(default_factory=list)
    features: list = field(default_factory=list)
    cuts: list = field(default_factory=list)
    gains: list = field(default_factory=list)
    totals: list = field(default_factory=list)

    def add(self, ids, features, cuts, gains, totals):
        for own, new in zip((self.ids, self.features, self.cuts, self.gains, self.totals), (ids, features, cuts, gains, totals)):
            own.append(np.asarray(new))

    def arrays(self):
        return [np.concatenate(a) for a in (self.ids, self.features, self.cuts, self.gains, self.totals)]


def grow_here(x: np.ndarray, c: np.ndarray, rule: Rule, columns: Columns, salt: int, root: int = 1):
    """Grow the subtree of node ``root`` over all given rows, level by level."""
    grown, depth = Grown(), int(root).bit_length() - 1
    ids, totals = np.array([root]), c.sum(axis=0, dtype=np.float64)[None, :]
    node = np.zeros(len(x), np.int64)
    shared = not columns.per_node
    narrowest, parents, small = np.array([np.inf]), None, None
    kept: list[np.ndarray] = []
    while len(ids):
        if depth >= rule.depth:
            none = np.zeros(len(ids))
            grown.add(ids, none.astype(np.int64) - 1, none.astype(np.int64), none, totals)
            break
        feats = columns.of_nodes(salt, ids)
        gain, slot, cut = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        left = np.zeros_like(totals)
        if shared:
            if parents is None:
                hist = histograms(x, c, node, len(ids), feats, rule.bins, True)
            else:  # the smaller sibling is counted, the other is the rest of the parent
                pick = small[node]
                rank = np.cumsum(small) - 1
                part = histograms(x[pick], c[pick], rank[node[pick]], int(small.sum()), feats, rule.bins, True)
                hist = np.empty((len(ids), *part.shape[1:]))
                hist[small] = part
                hist[~small] = parents - part
            gain, slot, cut, left = rule.best(hist, totals)
        else:
            order = np.argsort(node, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(ids)))])
            step = max(1, CELLS // (feats.shape[1] * rule.bins * c.shape[1]))
            for a in range(0, len(ids), step):
                b = min(len(ids), a + step)
                rows = order[ends[a] : ends[b]]
                hist = histograms(x[rows], c[rows], node[rows] - a, b - a, feats[a:b], rule.bins, False)
                gain[a:b], slot[a:b], cut[a:b], left[a:b] = rule.best(hist, totals[a:b])
        split = gain > 0
        narrow = np.minimum(narrowest, gain)
        if rule.leaves and split.any():
            # Best-first growth takes the splits with the widest bottleneck on their path.
            every = np.concatenate([*kept, narrow[split]])
            if len(every) > rule.leaves - 1:
                split &= narrow >= np.partition(every, -(rule.leaves - 1))[-(rule.leaves - 1)]
            kept.append(narrow[split])
        feature = np.where(split, feats[np.arange(len(ids)), slot], -1)
        grown.add(ids, feature, cut, np.where(split, gain, 0.0), totals)
        if not split.any():
            break
        stay = split[node]
        x, c, node = x[stay], c[stay], node[stay]
        right = x[np.arange(len(x)), feature[node]] > cut[node]
        rank = np.cumsum(split) - 1
        node = 2 * rank[node] + right
        if shared:
            parents = hist[split]
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], axis=1).ravel()
        totals = np.stack([left[split], totals[split] - left[split]], axis=1).reshape(-1, totals.shape[1])
        narrowest = np.repeat(narrow[split], 2)
        sizes = rule.size(totals).reshape(-1, 2)
        first = sizes[:, 0] <= sizes[:, 1]
        small = np.stack([first, ~first], axis=1).ravel()
        depth += 1
    return grown.arrays()


# ---- trees ---------------------------------------------------------------------------------


@dataclass
class Tree:
    """Flat nodes: ``left`` is the place of the left child, the right one follows it."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            go = x[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + go, at)


def flat_tree(ids, features, cuts, gains, totals, rule: Rule) -> Tree:
    """Order nodes by heap number, keep the best-first splits, drop what is below a leaf."""
    order = np.argsort(ids, kind="stable")
    ids, features, cuts, gains, totals = ids[order], features[order].copy(), cuts[order], gains[order], totals[order]
    place = {int(i): p for p, i in enumerate(ids)}
    narrow = np.full(len(ids), np.inf)
    for p, i in enumerate(ids):
        if features[p] >= 0:
            narrow[p] = min(gains[p], narrow[place[int(i) // 2]] if int(i) > 1 else np.inf)
    inner = np.flatnonzero(features >= 0)
    if rule.leaves and len(inner) > rule.leaves - 1:
        ranked = inner[np.lexsort((ids[inner], -narrow[inner]))]
        features[ranked[rule.leaves - 1 :]] = -1
    # Breadth first, so children of a node stand side by side.
    queue, left = [0], []
    for p in queue:
        if features[p] >= 0:
            left.append(len(queue))
            queue += [place[2 * int(ids[p])], place[2 * int(ids[p]) + 1]]
        else:
            left.append(-1)
    q = np.array(queue)
    return Tree(
        features[q].astype(np.int16), np.where(features[q] >= 0, cuts[q], 0).astype(np.uint8), np.array(left, np.int32),
        np.where(features[q] >= 0, gains[q], 0.0), rule.size(totals[q]), rule.value(totals[q]),
    )


#: Gives the rows of a unit's tree in a block: (row numbers, channels).
Emit = Callable[[pa.RecordBatch, int], "dict[int, tuple[np.ndarray, np.ndarray]]"]

_NODES = "unit int, ids binary, features binary, cuts binary, gains binary, totals binary"


def _node_of(x: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """Heap number of each row in a partly grown tree."""
    at = np.ones(len(x), np.int64)
    for i in sorted(splits):
        f, cut = splits[i]
        here = at == i
        at[here] = 2 * i + (x[here, f] > cut)
    return at


def grow(
    blocks: DataFrame,
    units: list[int],
    emit: Emit,
    rules: dict[int, Rule],
    columns: Columns,
    salts: dict[int, int],
    channels: int,
    rows_of: dict[int, float],
    local_rows: int = LOCAL_ROWS,
    partitions: int = 8,
) -> tuple[dict[int, Tree], np.ndarray | None]:
    """A tree for each unit, and the sum of what ``emit`` gives for unit -1.

    ``emit`` gives a block's rows and channels of every unit; ``rows_of`` says how many rows a unit
    has at most; all rules share their bins. Nodes of more than ``local_rows`` rows are split from summed histograms, a job for
    each level and all units; the driver holds the histograms of open large nodes, whose number is
    bounded by rows / local_rows and by the widest level. Smaller nodes are finished in tasks.
    """
    wide = columns.wide
    splits: dict[int, dict[int, tuple[int, int]]] = {u: {} for u in units}
    done: dict[int, list] = {u: [] for u in units}
    open_nodes: dict[int, list[int]] = {u: [1] for u in units}
    large = {u: [1] for u in units if rows_of[u] > local_rows}
    while large:
        bins = rules[next(iter(large))].bins
        found = _summed(blocks, emit, bins, columns, salts, {u: (splits[u], n) for u, n in large.items()})
        following: dict[int, list[int]] = {}
        for u, nodes in large.items():
            ids, rule = np.array(nodes), rules[u]
            feats = columns.of_nodes(salts[u], ids)
            shape = (len(ids), feats.shape[1], bins, channels)
            hist = found[u].reshape(shape) if u in found else np.zeros(shape)
            totals = hist[:, 0].sum(axis=1)
            gain, slot, cut, left = rule.best(hist, totals)
            for j, i in enumerate(nodes):
                if int(i).bit_length() - 1 >= rule.depth or gain[j] <= 0:
                    done[u].append((i, -1, 0, 0.0, totals[j]))
                    open_nodes[u].remove(i)
                    continue
                f = int(feats[j, slot[j]])
                splits[u][i] = (f, int(cut[j]))
                done[u].append((i, f, int(cut[j]), float(gain[j]), totals[j]))
                open_nodes[u].remove(i)
                for child, c in ((2 * i, left[j]), (2 * i + 1, totals[j] - left[j])):
                    open_nodes[u].append(child)
                    if rule.size(c) > local_rows and child.bit_length() - 1 < rule.depth:
                        following.setdefault(u, []).append(child)
        large = following

    def give(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[r].as_py(), np.uint8).reshape(-1, wide)
                for u, (rows, c) in emit(batch, r).items():
                    if u < 0:
                        yield _piece(u, 1, b"", c, channels)
                        continue
                    own = x[rows]
                    at = _node_of(own, splits[u])
                    for i in open_nodes[u]:
                        here = at == i
                        if here.any():
                            yield _piece(u, i, own[here].tobytes(), c[here], channels)

    def finish(key, table):
        u, root = key[0].as_py(), key[1].as_py()
        c = np.frombuffer(b"".join(table.column("c").to_pylist()), np.float32)
        if u < 0:
            total = np.frombuffer(b"".join(table.column("c").to_pylist()), np.float64).reshape(table.num_rows, -1).sum(axis=0)
            parts = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), total]
        else:
            x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(-1, wide)
            parts = grow_here(x, c.reshape(-1, channels).astype(np.float64), rules[u], columns, salts[u], root)
        kinds = (np.int64, np.int64, np.int64, np.float64, np.float64)
        names = ("ids", "features", "cuts", "gains", "totals")
        return pa.table(
            {"unit": pa.array([u], pa.int32())}
            | {n: pa.array([np.asarray(p, k).tobytes()], pa.binary()) for n, p, k in zip(names, parts, kinds)}
        )

    pieces = blocks.mapInArrow(give, "unit int, node long, x binary, c binary")
    out = pieces.repartition(partitions, "unit", "node").groupBy("unit", "node").applyInArrow(finish, _NODES).toArrow()
    extra = None
    got: dict[int, list] = {u: [] for u in units}
    for row in out.to_pylist():
        kinds = (np.int64, np.int64, np.int64, np.float64, np.float64)
        arrays = [np.frombuffer(row[n], k) for n, k in zip(("ids", "features", "cuts", "gains", "totals"), kinds)]
        if row["unit"] < 0:
            extra = arrays[4]
        else:
            arrays[4] = arrays[4].reshape(-1, channels)
            got[row["unit"]].append(arrays)
    trees = {}
    for u in units:
        if done[u]:
            ids, f, cut, gain, total = zip(*done[u])
            got[u].append([np.array(ids), np.array(f), np.array(cut), np.array(gain), np.array(total)])
        if not got[u]:  # no row at all
            got[u].append([np.array([1]), np.array([-1]), np.array([0]), np.zeros(1), np.zeros((1, channels))])
        trees[u] = flat_tree(*[np.concatenate(a) for a in zip(*got[u])], rules[u])
    return trees, extra


def _piece(unit: int, node: int, x: bytes, c: np.ndarray, channels: int) -> pa.RecordBatch:
    values = c.astype(np.float64 if unit < 0 else np.float32).tobytes()
    return pa.RecordBatch.from_pydict(
        {"unit": pa.array([unit], pa.int32()), "node": pa.array([node], pa.int64()), "x": [x], "c": [values]},
        pa.schema([("unit", pa.int32()), ("node", pa.int64()), ("x", pa.binary()), ("c", pa.binary())]),
    )


def _summed(blocks, emit, bins: int, columns: Columns, salts, wanted) -> dict[int, np.ndarray]:
    """Histograms of the wanted nodes of each unit, summed over all blocks."""
    wide = columns.wide

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[r].as_py(), np.uint8).reshape(-1, wide)
                for u, (rows, c) in emit(batch, r).items():
                    if u not in wanted:
                        continue
                    splits, nodes = wanted[u]
                    own = x[rows]
                    order = np.argsort(nodes)
                    at = _node_of(own, splits)
                    place = np.minimum(np.searchsorted(np.array(nodes)[order], at), len(nodes) - 1)
                    node = order[place]
                    mine = np.array(nodes)[node] == at
                    feats = columns.of_nodes(salts[u], np.array(nodes))
                    c32 = c[mine].astype(np.float32).astype(np.float64)
                    part = histograms(own[mine], c32, node[mine], len(nodes), feats, bins, not columns.per_node)
                    held[u] = held[u] + part if u in held else part
        for u, h in held.items():
            yield pa.RecordBatch.from_pydict({"unit": pa.array([u], pa.int32()), "h": [h.tobytes()]})

    def add(key, table):
        total = sum(np.frombuffer(h, np.float64) for h in table.column("h").to_pylist())
        return pa.table({"unit": pa.array([key[0].as_py()], pa.int32()), "h": pa.array([total.tobytes()], pa.binary())})

    parts = blocks.mapInArrow(count, "unit int, h binary")
    if blocks.rdd.getNumPartitions() > PARTIALS:
        dealt = parts.withColumn("deal", F.spark_partition_id() % PARTIALS)
        parts = dealt.groupBy("unit", "deal").applyInArrow(add, "unit int, h binary")
    out: dict[int, np.ndarray] = {}
    for row in parts.toArrow().to_pylist():
        h = np.frombuffer(row["h"], np.float64)
        out[row["unit"]] = out[row["unit"]] + h if row["unit"] in out else h
    return out
