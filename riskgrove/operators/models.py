"""Tree ensembles for a class label: fitting, scoring and node-level importances."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskgrove.operators import trees as T
from riskgrove.operators.evaluate import argmax
from riskgrove.operators.select import hash_order
from riskgrove.session import shared_path

SEED = 42

#: Rounds after which the margins of the rows are written to a table. Until then a round moves the
#: margins of the last table by all trees since, so its plan has one step over a table, however many
#: rounds there were.
ROUNDS_PER_TABLE = 10

#: Rows below which one more task for the blocks does not pay.
ROWS_PER_TASK = 4_000


@dataclass(frozen=True)
class BoostProfile:
    """Settings of a boosted ensemble. With ``leaves`` a tree takes its best splits first; without,
    it grows level by level to its depth."""

    rounds: int = 500
    depth: int = 8
    leaves: int = 63
    step: float = 0.05
    min_child: int = 20
    min_hessian: float = 1e-3
    row_share: float = 0.8
    column_share: float = 0.8
    l1: float = 0.1
    l2: float = 0.1
    patience: int = 50
    bins: int = 64

    def rule(self) -> T.Rule:
        return T.Rule(
            True, self.bins, self.depth, self.min_child, 2 * self.min_child, self.min_hessian, self.l1, self.l2, self.leaves
        )


@dataclass(frozen=True)
class ForestProfile:
    trees: int = 300
    depth: int = 15
    min_child: int = 5
    min_split: int = 10
    columns: str = "sqrt"
    bins: int = 64

    def rule(self) -> T.Rule:
        return T.Rule(False, self.bins, self.depth, self.min_child, self.min_split)


# The published sizes.
FIRST_BOOST = BoostProfile()
SECOND_BOOST = BoostProfile(leaves=0, min_child=0, min_hessian=1.0)
FOREST = ForestProfile()
TUNED_BOOST = BoostProfile(rounds=300, l1=0.0, l2=0.0, patience=5)

#: Rounds of the registered grid search; its 48 fits share each round (see README for times).
GRID_ROUNDS = 8


@dataclass
class Ensemble:
    """A fitted ensemble: trees by class and round (boosted), or one list of trees (forest).

    A boosted margin is ``base`` plus ``step`` times the sum of its trees; a forest's is the mean
    of its trees' class shares. The number of nodes is bounded by the profile.
    """

    features: list[str]
    classes: list[int]
    edges: list[np.ndarray]
    boosted: bool
    step: float
    base: list[float]
    trees: list[list[T.Tree]]
    losses: list[float] = field(default_factory=list)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Margins (row, class) of raw feature values."""
        b = T.binned(x, self.edges)
        if not self.boosted:
            out = np.zeros((len(x), len(self.classes)))
            for tree in self.trees[0]:
                out += tree.value[tree.leaf_of(b)]
            return out / max(len(self.trees[0]), 1)
        out = np.tile(np.array(self.base, float), (len(x), 1))
        for k, own in enumerate(self.trees):
            for tree in own:
                out[:, k] += self.step * tree.value[tree.leaf_of(b), 0]
        return out


def is_forest(model: Ensemble) -> bool:
    return not model.boosted


# ---- boosting ------------------------------------------------------------------------------


def softmax(margins: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    e = np.exp(margins - margins.max(axis=0))
    return e / e.sum(axis=0)


@dataclass
class Fit:
    """One of several boosted fits that share their passes: rows with this tag are held out."""

    profile: BoostProfile
    held: int
    trees: list[list[T.Tree]]
    losses: list[float] = field(default_factory=list)
    confusions: list[np.ndarray] = field(default_factory=list)
    seconds: float = 0.0

    def best(self) -> int:
        """Rounds of the lowest held-out loss, all rounds without held-out rows."""
        return int(np.argmin(self.losses)) + 1 if self.losses else len(self.trees[0])

    def over(self) -> bool:
        if len(self.trees[0]) >= self.profile.rounds:
            return True
        return bool(self.losses) and len(self.losses) - self.best() >= self.profile.patience


def fit_together(
    blocks: DataFrame, counts: dict[int, dict[int, int]], fits: list[Fit], classes: list[int], wide: int, local_rows: int = T.LOCAL_ROWS
) -> list[float]:
    """Boost all fits side by side; returns the base margins.

    ``counts``: rows by tag and class. Each round is a pass over the blocks: the margins of every
    row move by the trees since the last table, the held-out loss and confusion are summed, and each class of each
    fit that is not over grows a tree on its rows (softmax loss, gradient and hessian). A fit is
    over after its rounds or when ``patience`` rounds brought no gain; it leaves the passes then.
    """
    spark, k = blocks.sparkSession, len(classes)
    totals = np.array([sum(c.get(y, 0) for c in counts.values()) for y in range(k)], float)
    base = np.log(np.maximum(totals, 0.5) / max(totals.sum(), 1.0))
    number = {c: i for i, c in enumerate(classes)}
    assert list(number.values()) == list(range(k))

    def start(batches):
        for batch in batches:
            m = [np.repeat(base.astype(np.float32)[None, :, None], len(fits), 0).repeat(n, 2).tobytes() for n in batch.column("n").to_pylist()]
            yield batch.append_column("m", pa.array(m, pa.binary())).append_column("stats", pa.array([b""] * len(m), pa.binary()))

    kind = "x binary, y binary, tag binary, h binary, n long, m binary, stats binary"
    table = blocks.mapInArrow(start, kind)
    since: list[dict[int, list[T.Tree]]] = []  # trees of the rounds after the table
    new: dict[int, list[T.Tree]] = {}
    rounds = 0
    while True:
        state = table.mapInArrow(_moved(list(since), fits, k, wide), kind) if since else table
        if len(since) >= ROUNDS_PER_TABLE:
            path = shared_path(spark, "margins")
            state.write.parquet(path)
            table, since = spark.read.schema(state.schema).parquet(path), []
            state = table
        several = totals.sum() > local_rows
        if several:  # more than one job reads it
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
        began = time.perf_counter()
        active = [i for i, f in enumerate(fits) if len(f.trees[0]) < f.profile.rounds and not f.over()]
        grown, stats = T.grow(
            state,
            [i * k + c for i in active for c in range(k)],
            _emitted(active, fits, k, rounds),
            {i * k + c: fits[i].profile.rule() for i in active for c in range(k)},
            T.Columns(wide, fits[0].profile.column_share),
            {i * k + c: SEED + 1000 * rounds + c for i in active for c in range(k)},
            3,
            {i * k + c: sum(sum(v.values()) for t, v in counts.items() if t != fits[i].held) for i in active for c in range(k)},
            local_rows,
            partitions=max(1, min(2 * len(active) * k, 64)),
        )
        if several:
            state.unpersist()
        if rounds and stats is not None:
            for i, f in enumerate(fits):
                own = stats.reshape(len(fits), 2 + k * k)[i]
                if i in new and own[1] > 0:
                    f.losses.append(own[0] / own[1])
                    f.confusions.append(own[2:].reshape(k, k))
        new = {}
        for i in active:
            if not fits[i].over():
                new[i] = [grown[i * k + c] for c in range(k)]
                for c in range(k):
                    fits[i].trees[c].append(new[i][c])
                fits[i].seconds += (time.perf_counter() - began) / len(active)
        rounds += 1
        if not new:
            break
        since.append(new)
    return base.tolist()


def _moved(since: list[dict[int, list[T.Tree]]], fits: list[Fit], k: int, wide: int):
    """Move the margins by the trees of some rounds and measure the held-out rows of the last one."""
    steps = [f.profile.step for f in fits]
    held = [f.held for f in fits]

    def go(batches):
        for batch in batches:
            ms, stats = [], []
            for r in range(batch.num_rows):
                x, y, tag, _ = T.of_block(batch, r, wide)
                m = np.frombuffer(batch.column("m")[r].as_py(), np.float32).reshape(len(steps), k, len(y)).copy()
                s = np.zeros((len(steps), 2 + k * k))
                for new in since:
                    for i, own in new.items():
                        for c, tree in enumerate(own):
                            m[i, c] += (steps[i] * tree.value[tree.leaf_of(x), 0]).astype(np.float32)
                for i in since[-1]:
                    out = np.flatnonzero(tag == held[i])
                    if len(out):
                        p = softmax(m[i][:, out].astype(np.float64))
                        truth = y[out].astype(np.int64)
                        s[i, 0] = -np.log(np.maximum(p[truth, np.arange(len(out))], 1e-15)).sum()
                        s[i, 1] = len(out)
                        s[i, 2:] = np.bincount(truth * k + p.argmax(axis=0), minlength=k * k)
                ms.append(m.tobytes())
                stats.append(s.tobytes())
            for name, values in (("m", ms), ("stats", stats)):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, name, pa.array(values, pa.binary()))
            yield batch

    return go


def _emitted(active: list[int], fits: list[Fit], k: int, rounds: int):
    shares = {i: (fits[i].profile.row_share, fits[i].held) for i in active}

    def emit(batch, r):
        _, y, tag, h = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("x", np.uint8), ("y", np.int8), ("tag", np.int8), ("h", np.int64)))
        m = np.frombuffer(batch.column("m")[r].as_py(), np.float32).reshape(-1, k, len(y))
        draw = T.shares_of(h.view(np.uint64), SEED + rounds)
        out = {}
        stats = batch.column("stats")[r].as_py()
        if stats:
            out[-1] = (None, np.frombuffer(stats, np.float64))
        for i, (share, held) in shares.items():
            rows = np.flatnonzero((tag != held) & (draw < share))
            if not len(rows):
                continue
            p = softmax(m[i][:, rows].astype(np.float64))
            for c in range(k):
                g = p[c] - (y[rows] == c)
                out[i * k + c] = (rows, np.stack([g, p[c] * (1 - p[c]), np.ones(len(rows))], axis=1))
        return out

    return emit


def _packed(rows: DataFrame, features: list[str], classes: list[int], bins: int, label: str, tag: str, key: str, edges=None):
    """The blocks of a table as a table of their own, its edges, and its rows by tag and class."""
    spark = rows.sparkSession
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("int")).cast("int") - 1
    coded = rows.where(number >= 0).withColumn("__y", number)
    edges = T.edges_of(coded, features, bins) if edges is None else edges
    path = shared_path(spark, "blocks")
    counts: dict[int, dict[int, int]] = {}
    for t, y, n in coded.groupBy(tag, "__y").count().collect():
        counts.setdefault(t, {})[y] = n
    total = sum(sum(c.values()) for c in counts.values())
    cores = max(1, min(spark.sparkContext.defaultParallelism, total // ROWS_PER_TASK))
    each = total // (2 * cores) + 1
    T.blocks_of(coded, features, edges, "__y", tag, key, max(2048, min(T.BLOCK_ROWS, each))).write.parquet(path)
    blocks = spark.read.parquet(path)
    if blocks.rdd.getNumPartitions() < cores:
        blocks = blocks.repartition(cores)
    return blocks.persist(StorageLevel.MEMORY_AND_DISK), edges, counts


def fit_boosted(
    train: DataFrame,
    features: list[str],
    classes: list[int],
    profile: BoostProfile,
    key: str | None = None,
    label: str = "label",
    local_rows: int = T.LOCAL_ROWS,
) -> Ensemble:
    """A boosted ensemble with a softmax over the classes.

    With a key, a repeatable tenth of the training rows is held out of the fit: the fit stops when
    ``patience`` rounds brought no lower loss on it and keeps the rounds up to the lowest; the test
    rows play no part in fitting. Rows with another label than ``classes`` are left out. A missing
    feature value stands above all edges.
    """
    tagged = train.withColumn(
        "__tag", (F.substring(hash_order(key, SEED + 1), 1, 2) < "1a").cast("int") if key else F.lit(0)
    )
    own = key or "__id"
    if not key:
        tagged = tagged.withColumn("__id", F.xxhash64(*[F.col(f"`{c}`") for c in features]))
    blocks, edges, counts = _packed(tagged, features, classes, profile.bins, label, "__tag", own)
    fit = Fit(profile, 1, [[] for _ in classes])
    base = fit_together(blocks, counts, [fit], classes, len(features), local_rows)
    blocks.unpersist()
    kept = fit.best()
    return Ensemble(features, classes, edges, True, profile.step, base, [t[:kept] for t in fit.trees], fit.losses)


def fit_folds(
    folded: DataFrame, features: list[str], classes: list[int], profiles: list[BoostProfile], k: int, key: str, label: str = "label"
) -> list[list[Fit]]:
    """Every profile with each of k folds (column ``fold``) held out in turn, in shared passes."""
    blocks, _, counts = _packed(folded, features, classes, profiles[0].bins, label, "fold", key)
    fits = [[Fit(p, fold, [[] for _ in classes]) for fold in range(k)] for p in profiles]
    fit_together(blocks, counts, [f for own in fits for f in own], classes, len(features))
    blocks.unpersist()
    return fits


# ---- forest --------------------------------------------------------------------------------

#: Trees that are grown by the same jobs.
TREES_TOGETHER = 75


def fit_forest(
    train: DataFrame,
    features: list[str],
    profile: ForestProfile,
    label: str = "label",
    classes: list[int] | None = None,
    key: str | None = None,
    local_rows: int = T.LOCAL_ROWS,
) -> Ensemble:
    """A forest of class-share trees. Each tree weighs rows by a Poisson draw of mean one, from the
    hash of key and tree; each node looks at its own random features."""
    classes = classes or sorted(r[0] for r in train.select(F.col(label).cast("int")).distinct().collect() if r[0] is not None)
    tagged = train.withColumn("__tag", F.lit(0))
    own = key or "__id"
    if not key:
        tagged = tagged.withColumn("__id", F.xxhash64(*[F.col(f"`{c}`") for c in features]))
    blocks, edges, counts = _packed(tagged, features, classes, profile.bins, label, "__tag", own)
    wide, k = len(features), len(classes)
    per_node = max(1, int(np.sqrt(wide))) if profile.columns == "sqrt" else wide
    rows = sum(sum(c.values()) for c in counts.values())
    cuts = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)])

    def emitted(some: list[int]):
        def emit(batch, r):
            y = np.frombuffer(batch.column("y")[r].as_py(), np.int8)
            h = np.frombuffer(batch.column("h")[r].as_py(), np.int64).view(np.uint64)
            out = {}
            for t in some:
                w = np.searchsorted(cuts, T.shares_of(h, SEED + 7919 * (t + 1)), side="right")
                rows = np.flatnonzero(w)
                c = np.zeros((len(rows), k))
                c[np.arange(len(rows)), y[rows]] = w[rows]
                out[t] = (rows, c)
            return out

        return emit

    grown: list[T.Tree] = []
    for a in range(0, profile.trees, TREES_TOGETHER):
        some = list(range(a, min(profile.trees, a + TREES_TOGETHER)))
        made, _ = T.grow(
            blocks, some, emitted(some), dict.fromkeys(some, profile.rule()), T.Columns(wide, per_node=per_node),
            {t: SEED + 104729 * (t + 1) for t in some}, k, dict.fromkeys(some, rows), local_rows, partitions=len(some),
        )
        grown += [made[t] for t in some]
    blocks.unpersist()
    return Ensemble(features, classes, edges, False, 1.0, [0.0] * k, [grown])


# ---- scoring -------------------------------------------------------------------------------


def _outputs(model: Ensemble, spark: SparkSession) -> Column:
    """The margins of a row as an array; the model travels to each task once."""
    shared, wide, k = spark.sparkContext.broadcast(model), len(model.features), len(model.classes)

    @F.arrow_udf("array<double>")
    def out(x: pa.Array) -> pa.Array:
        if isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        values = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, wide)
        found = shared.value.outputs(values)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, k), pa.int32()), pa.array(found.ravel()))

    return out(F.array(*[F.col(f"`{c}`").cast("double") for c in model.features]))


def score(model: Ensemble, rows: DataFrame, classes: list[int]) -> DataFrame:
    """Add p0, p1, ... (summing to 1) and the class of the largest one as prediction."""
    out = rows.withColumn("__m", _outputs(model, rows.sparkSession))
    m = [F.col("__m")[i] for i in range(len(classes))]
    if model.boosted:
        top = F.greatest(*m) if len(m) > 1 else m[0]
        m = [F.exp(v - top) for v in m]
    out = out.withColumns({f"__p{k}": v for k, v in zip(classes, m)})
    total = sum((F.col(f"__p{k}") for k in classes), F.lit(0.0))
    out = out.withColumns({f"p{k}": F.col(f"__p{k}") / total for k in classes})
    out = out.withColumn("prediction", argmax([F.col(f"p{k}") for k in classes]))
    return out.select(*rows.columns, *[f"p{k}" for k in classes], "prediction")


def margins(model: Ensemble, rows: DataFrame, classes: list[int]) -> DataFrame:
    """Add m0, m1, ...: the summed trees per class (boosted) or the vote share (forest)."""
    out = rows.withColumn("__m", _outputs(model, rows.sparkSession))
    return out.select(*rows.columns, *[F.col("__m")[i].alias(f"m{k}") for i, k in enumerate(classes)])


# ---- nodes ---------------------------------------------------------------------------------

_NODES = (
    "class int, tree int, id int, left int, right int, feature int, cut int, threshold double, gain double, "
    "cover double, value array<double>"
)


def tree_nodes(model: Ensemble, classes: list[int], spark: SparkSession) -> DataFrame:
    """All nodes of an ensemble: (class, tree, id, ...), class -1 for a forest.

    A node whose ``feature`` is null is a leaf; rows with a value up to ``threshold`` go left.
    """
    parts = []
    for i, own in enumerate(model.trees):
        for t, tree in enumerate(own):
            n, inner = len(tree.feature), tree.feature >= 0
            lines = [
                model.edges[f][min(c, len(model.edges[f]) - 1)] if f >= 0 and len(model.edges[f]) else 0.0
                for f, c in zip(tree.feature, tree.cut)
            ]
            width = tree.value.shape[1]
            pick = lambda v, kind: pa.array(np.asarray(v), kind, mask=~inner)
            parts.append(
                pa.table(
                    {
                        "class": pa.array(np.full(n, classes[i] if model.boosted else -1), pa.int32()),
                        "tree": pa.array(np.full(n, t), pa.int32()),
                        "id": pa.array(np.arange(n), pa.int32()),
                        "left": pick(tree.left, pa.int32()),
                        "right": pick(tree.left + 1, pa.int32()),
                        "feature": pick(tree.feature.astype(np.int32), pa.int32()),
                        "cut": pick(tree.cut.astype(np.int32), pa.int32()),
                        "threshold": pick(np.array(lines, float), pa.float64()),
                        "gain": pick(tree.gain, pa.float64()),
                        "cover": pa.array(tree.cover, pa.float64()),
                        "value": pa.ListArray.from_arrays(
                            pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(tree.value.ravel())
                        ),
                    }
                )
            )
    if not parts:
        return spark.createDataFrame([], _NODES)
    return spark.createDataFrame(pa.concat_tables(parts), _NODES)


def save_ensemble(model: Ensemble, spark: SparkSession, path: str) -> None:
    """One table of nodes, and one row of settings beside it."""
    tree_nodes(model, model.classes, spark).write.mode("overwrite").parquet(f"{path}/nodes")
    settings = {
        "features": model.features, "classes": model.classes, "edges": [e.tolist() for e in model.edges],
        "boosted": model.boosted, "step": model.step, "base": model.base, "losses": model.losses,
    }
    spark.createDataFrame([(json.dumps(settings),)], "settings string").write.mode("overwrite").parquet(f"{path}/settings")


def load_ensemble(spark: SparkSession, path: str) -> Ensemble:
    s = json.loads(spark.read.parquet(f"{path}/settings").first()[0])
    nodes = spark.read.parquet(f"{path}/nodes").toArrow()
    at = {n: nodes.column(n).to_numpy(zero_copy_only=False) for n in nodes.column_names if n != "value"}
    values = nodes.column("value").combine_chunks()
    width = len(values.flatten()) // max(len(values), 1)
    values = values.flatten().to_numpy().reshape(-1, max(width, 1))
    order = np.lexsort((at["id"], at["tree"], at["class"]))
    trees: list[list[T.Tree]] = [[] for _ in (s["classes"] if s["boosted"] else [0])]
    bounds = np.flatnonzero(at["id"][order] == 0).tolist() + [len(order)]
    filled = lambda name, rows, none: np.nan_to_num(at[name][rows].astype(float), nan=none)
    for a, b in zip(bounds[:-1], bounds[1:]):
        rows = order[a:b]
        tree = T.Tree(
            filled("feature", rows, -1).astype(np.int16), filled("cut", rows, 0).astype(np.uint8),
            filled("left", rows, -1).astype(np.int32), filled("gain", rows, 0.0), at["cover"][rows], values[rows],
        )
        trees[s["classes"].index(int(at["class"][rows[0]])) if s["boosted"] else 0].append(tree)
    edges = [np.array(e, float) for e in s["edges"]]
    return Ensemble(s["features"], s["classes"], edges, s["boosted"], s["step"], s["base"], trees, s["losses"])


def importances(nodes: DataFrame, features: list[str]) -> DataFrame:
    """(position, feature, importance_split, importance_gain) over all features."""
    splits = nodes.where(F.col("feature").isNotNull()).groupBy(F.col("feature").alias("position")).agg(
        F.count("*").alias("n"), F.sum("gain").alias("g")
    )
    names = nodes.sparkSession.createDataFrame(
        list(enumerate(features)), "position int, feature string"
    )
    return names.join(splits, "position", "left").select(
        "position",
        "feature",
        F.coalesce("n", F.lit(0)).alias("importance_split"),
        F.coalesce("g", F.lit(0.0)).alias("importance_gain"),
    )
