"""Centroid clustering with heap-ordered bounds.

A vector with distance u to its centroid and l to the second nearest stays where it is until the
centroids have moved by l - u in sum. Each cluster keeps a heap of these gaps, every gap raised by
the drift the cluster had accumulated when it was pushed; a round pops only gaps that the drift has
passed and scans those vectors exactly against all centroids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from riskgrove.llm.common import quoted, settled
from riskgrove.session import shared_dir

#: Components of a vector, steps of a component, clusters and rounds.
DIMS = 64
STEPS = 256
CLUSTERS = 40
ROUNDS = 5
#: The centroids start as the vectors with the smallest digest of this and the id.
SEED_PREFIX = "2:"

#: Components in steps up to this size keep all sums of squares exact in doubles.
LARGEST = 1 << 22

#: Relative slack for the rounding of square roots and sums of drifts.
SLACK = 1e-9

#: Rounds after which the state is cut from its lineage by a checkpoint.
ROUNDS_PER_CHECKPOINT = 8

_BLOCK = (
    "ids binary, nulls binary, vectors binary, own binary, keys binary, places binary, sizes binary, "
    "sums array<long>, scanned long"
)


@dataclass
class Block:
    """Some thousand vectors with the heaps of all clusters.

    ``own``: cluster of each vector. ``heaps``: for each cluster a heap of (key, place in the
    block). ``sums``: for each cluster its component sums, then its count.
    """

    ids: np.ndarray
    nulls: np.ndarray
    vectors: np.ndarray
    own: np.ndarray
    heaps: list[list[tuple[float, int]]]
    sums: np.ndarray
    scanned: int = 0


def whole_steps(batch: pa.RecordBatch, dims: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, null ids, vectors) of the rows with exactly ``dims`` finite components, in steps."""
    column = batch.column("embedding").cast(pa.list_(pa.float64()))
    lengths = np.diff(column.offsets.to_numpy())
    full = (lengths == dims) & ~column.is_null().to_numpy(zero_copy_only=False)
    kept = batch.filter(pa.array(full))
    flat = kept.column("embedding").cast(pa.list_(pa.float64())).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null: NaN
    good = np.isfinite(values).all(axis=1)
    found = np.floor(values[good] * steps)
    if found.size and np.abs(found).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST} steps would not be exact")
    ids = kept.column("id").filter(pa.array(good))
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy().astype(np.int64), nulls, found


def two_nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, distance, distance of the second nearest); ties go to the smaller number.

    All squares are whole numbers below 2**53, so they are exact.
    """
    squares = (vectors**2).sum(axis=1)[:, None] - 2.0 * (vectors @ centroids.T) + (centroids**2).sum(axis=1)
    rows = np.arange(len(vectors))
    own = squares.argmin(axis=1)
    first = squares[rows, own]
    squares[rows, own] = np.inf
    second = squares.min(axis=1) if centroids.shape[0] > 1 else np.full(len(vectors), np.inf)
    return own, np.sqrt(first), np.sqrt(second)


def rescan(block: Block, places: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> None:
    """Assign the vectors at ``places`` exactly, mend the sums and push their gaps."""
    if not len(places):
        return
    vectors = block.vectors[places]
    own, near, far = two_nearest(vectors, centroids)
    before = block.own[places]
    moved = np.flatnonzero(before != own)
    counted = np.hstack([vectors[moved], np.ones((len(moved), 1))]).astype(np.int64)
    known = before[moved] >= 0
    np.subtract.at(block.sums, before[moved][known], counted[known])
    np.add.at(block.sums, own[moved], counted)
    block.own[places] = own
    # A gap of nothing is a tie: it is popped in every round.
    gaps = far - near - SLACK * (far + near + 1.0)
    for key, place, cluster in zip((gaps + drift[own]).tolist(), places.tolist(), own.tolist()):
        heapq.heappush(block.heaps[cluster], (key, place))
    block.scanned += len(places)


def expired(heap: list[tuple[float, int]], drift: float) -> list[int]:
    """Pop the places whose gap the accumulated drift has passed."""
    popped = []
    while heap and heap[0][0] <= drift:
        popped.append(heapq.heappop(heap)[1])
    return popped


def first_block(ids, nulls, vectors, centroids: np.ndarray) -> Block:
    n, k = len(ids), len(centroids)
    sums = np.zeros((k, vectors.shape[1] + 1), np.int64)
    block = Block(ids, nulls, vectors, np.full(n, -1, np.int64), [[] for _ in range(k)], sums)
    rescan(block, np.arange(n), centroids, np.zeros(k))
    return block


def advance(block: Block, centroids: np.ndarray, drift: np.ndarray) -> Block:
    """One round: pop what has expired in each cluster, then scan it."""
    block.scanned = 0
    places = [p for cluster, heap in enumerate(block.heaps) for p in expired(heap, drift[cluster])]
    rescan(block, np.array(sorted(places), np.int64), centroids, drift)
    return block


def _packed(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    for b in blocks:
        entries = [entry for heap in b.heaps for entry in heap]
        yield pa.RecordBatch.from_pydict(
            {
                "ids": [b.ids.tobytes()],
                "nulls": [b.nulls.astype(bool).tobytes()],
                "vectors": [b.vectors.astype(np.int32).tobytes()],
                "own": [b.own.astype(np.int32).tobytes()],
                "keys": [np.array([e[0] for e in entries], np.float64).tobytes()],
                "places": [np.array([e[1] for e in entries], np.int32).tobytes()],
                "sizes": [np.array([len(h) for h in b.heaps], np.int32).tobytes()],
                "sums": pa.array([b.sums.ravel().tolist()], pa.list_(pa.int64())),
                "scanned": pa.array([b.scanned], pa.int64()),
            },
            pa.schema(
                [(n, pa.binary()) for n in ("ids", "nulls", "vectors", "own", "keys", "places", "sizes")]
                + [("sums", pa.list_(pa.int64())), ("scanned", pa.int64())]
            ),
        )


def _unpacked(batch: pa.RecordBatch, dims: int) -> Iterator[Block]:
    for r in range(batch.num_rows):
        get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), kind)
        keys, places = get("keys", np.float64).tolist(), get("places", np.int32).tolist()
        ends = np.concatenate([[0], np.cumsum(get("sizes", np.int32))])
        heaps = [list(zip(keys[a:b], places[a:b])) for a, b in zip(ends[:-1], ends[1:])]
        sums = np.array(batch.column("sums")[r].as_py(), np.int64).reshape(len(heaps), dims + 1)
        yield Block(
            get("ids", np.int64),
            get("nulls", np.bool_),
            get("vectors", np.int32).reshape(-1, dims).astype(np.float64),
            get("own", np.int32).astype(np.int64),
            heaps,
            sums,
        )


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far a round narrows the gap of each cluster: its own move and the largest other move."""
    moves = np.sqrt(((new - old) ** 2).sum(axis=1))
    if len(moves) < 2:
        return moves
    largest = np.sort(moves)[::-1]
    others = np.where(moves == largest[0], largest[1] if (moves == largest[0]).sum() == 1 else largest[0], largest[0])
    return (moves + others) * (1.0 + SLACK)


def summed(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """Component sums and counts of the clusters: k * (dims + 1) numbers reach the driver."""
    cells = state.select(F.posexplode("sums").alias("at", "part")).groupBy("at").agg(F.sum("part").alias("s"))
    out = np.zeros(k * (dims + 1), np.int64)
    for at, s in cells.collect():
        out[at] = s
    return out.reshape(k, dims + 1)


def moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Exact floor of sum by count; an empty cluster stays."""
    counts = sums[:, -1:]
    return np.where(counts > 0, sums[:, :-1] // np.maximum(counts, 1), centroids).astype(np.float64)


def starts(vectors: DataFrame, k: int, dims: int, steps: int, prefix: str) -> np.ndarray:
    """The k vectors with the smallest digest of prefix and id, in that order; fewer if there are
    fewer vectors. Repeated ids are ordered by their components."""
    step = F.transform("embedding", lambda x: F.floor(F.lit(float(steps)) * x.cast("double")))
    good = (F.size("embedding") == dims) & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    named = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(named.alias("name"), step.alias("v"))
    found = rows.orderBy("name", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.float64).reshape(-1, dims)


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    steps: int = STEPS,
    prefix: str = SEED_PREFIX,
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id, cluster, distance) of every kept vector, the centroids, and the vectors scanned in each
    round.

    Vectors with exactly ``dims`` components, none null or non-finite, are kept; a component x
    becomes floor(steps * x). Every round assigns all vectors (squared Euclidean distance, ties to
    the smaller number) and replaces each non-empty centroid by the floor of its mean; at the end
    they are assigned once more. Vectors stay in blocks of one Arrow batch; a round passes over the
    blocks, pops expired vectors and brings k * (dims + 1) sums to the driver. The state of a
    round is kept on disk and in memory while the next one is made; a lost block is made anew from
    the input, and every ``ROUNDS_PER_CHECKPOINT`` rounds a checkpoint cuts that lineage.

    Ids may be null or repeated; every kept row gives one row. No kept vector gives an empty
    table. Other columns play no part.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("embedding"))
    centroids = starts(rows, k, dims, steps, prefix)
    k = len(centroids)
    if not k:
        empty = spark.createDataFrame([], "id long, cluster int, distance long")
        return empty.withColumn("id", F.col("id").cast(kind)), centroids, []

    first = centroids

    def begin(batches):
        for batch in batches:
            ids, nulls, found = whole_steps(batch, dims, steps)
            if len(ids):
                yield from _packed(iter([first_block(ids, nulls, found, first)]))

    def keep(state):
        return state.persist(StorageLevel.MEMORY_AND_DISK)

    state = keep(rows.mapInArrow(begin, _BLOCK))
    drift, scanned = np.zeros(k), []
    for number in range(rounds):
        new = moved(centroids, summed(state, k, dims))
        scanned.append(state.agg(F.sum("scanned")).first()[0] or 0)
        drift = drift + drifts(centroids, new)
        centroids = new
        following = _advanced(state, centroids, drift, dims)
        if (number + 1) % ROUNDS_PER_CHECKPOINT == 0:
            _checkpoint_folder(spark)
            following = following.checkpoint()
        else:
            following = keep(following)
            following.agg(F.sum("scanned")).first()
        state.unpersist()
        state = following
    scanned.append(state.agg(F.sum("scanned")).first()[0] or 0)
    found = settled(_distances(state, centroids, dims, kind), "clusters")
    state.unpersist()
    return found, centroids, scanned


def _checkpoint_folder(spark) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _advanced(state: DataFrame, centroids: np.ndarray, drift: np.ndarray, dims: int) -> DataFrame:
    def go(batches):
        for batch in batches:
            yield from _packed(advance(b, centroids, drift) for b in _unpacked(batch, dims))

    return state.mapInArrow(go, _BLOCK)


def _distances(state: DataFrame, centroids: np.ndarray, dims: int, kind) -> DataFrame:
    def measure(batches):
        for batch in batches:
            for b in _unpacked(batch, dims):
                off = ((b.vectors - centroids[b.own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.ids, pa.int64(), mask=np.array(b.nulls)),
                        pa.array(b.own.astype(np.int32), pa.int32()),
                        pa.array(off.astype(np.int64), pa.int64()),
                    ],
                    names=["id", "cluster", "distance"],
                )

    found = state.mapInArrow(measure, "id long, cluster int, distance long")
    return found.withColumn("id", F.col("id").cast(kind))


def named_centroids(centroids: Sequence[Sequence[float]]) -> list[str]:
    """Each centroid's components as whole numbers, joined by commas."""
    return [",".join(str(int(c)) for c in row) for row in centroids]
