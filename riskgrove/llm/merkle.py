"""Merkle manifest: a content-addressed DAG of digests, and proofs by descent from its root.

The store is a table (level, digest, children). Leaves of a source form a tree; the roots of the
sources form the tree above. A proof descends from the root: at every level the next digit of
the leaf's rank selects a child, the unselected children are collected, and the path is reversed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskgrove.llm.common import quoted, settled
from riskgrove.session import shared_path

#: Children of a node.
ARITY = 3

#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Steps of a descent after which the requests are written to a table.
STEPS_PER_TABLE = 6

_PATH = "array<struct<digit:int,others:array<binary>>>"


def digest_of(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, as_hex), "")


def leaf_text(fields: Sequence[Column]) -> Column:
    """Each field as its byte count, a colon and its value, or ``-`` if null, without separators."""
    parts = []
    for field in fields:
        value = field.cast("string")
        full = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(full, F.lit("-")))
    return F.concat(*parts)


@dataclass(frozen=True)
class Manifest:
    """A built manifest.

    ``leaves``: a row for each document: (tree, at, depth, digest, kept) with its source's number,
    its rank there and the values of the columns kept beside it. ``trees``: a row for each source:
    (tree, source, n, depth, digest). ``store``: the folder of (level, digest, children), with one
    sub-folder for each level of the sources' trees and ``top=...`` for those of the tree above.
    """

    leaves: DataFrame
    trees: DataFrame
    root: str
    depth: int
    top_depth: int
    store: str
    arity: int = ARITY


def depth_of(n: Column, arity: int = ARITY) -> Column:
    """Levels above n nodes until one is left, counted in whole numbers."""
    steps = F.sequence(F.lit(1), F.lit(64))
    held = F.aggregate(
        steps,
        F.struct(n.cast("long").alias("n"), F.lit(0).alias("d")),
        lambda s, _: F.when(
            s["n"] > 1,
            F.struct(F.floor((s["n"] + (arity - 1)) / arity).cast("long").alias("n"), (s["d"] + 1).alias("d")),
        ).otherwise(s),
    )
    return held["d"]


def _raised(nodes: DataFrame, arity: int) -> DataFrame:
    """The parents (tree, at, depth, digest, children) of nodes (tree, at, depth, digest)."""
    own = F.struct("at", "digest")
    groups = nodes.groupBy("tree", F.expr(f"at div {arity}").alias("above"), "depth").agg(
        F.transform(F.sort_array(F.collect_list(own)), lambda c: c["digest"]).alias("children")
    )
    return groups.select(
        "tree", F.col("above").alias("at"), "depth", digest_of(joined_hex(F.col("children"))).alias("digest"), "children"
    )


def _grow(nodes: DataFrame, depth: int, folder: str, arity: int) -> DataFrame:
    """Write the records of every level above the nodes; returns the roots (tree, digest)."""
    spark = nodes.sparkSession
    roots = nodes.where("depth = 0").select("tree", "digest")
    for level in range(1, depth + 1):
        path = f"{folder}={level}"
        _raised(nodes.where(F.col("depth") >= level), arity).write.parquet(path)
        nodes = spark.read.parquet(path).drop("children")
        roots = roots.unionByName(nodes.where(F.col("depth") == level).select("tree", "digest"))
    return roots


def build(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    arity: int = ARITY,
    **keep: Column,
) -> Manifest:
    """Write the store of a table and return its manifest; ``keep`` are narrow columns kept beside
    each leaf.

    A leaf is the digest of ``leaf_text`` of the fields. Leaves of a source ascend by id, null
    first; rows with equal ids by their digest, so equal rows are interchangeable. Ranks come from
    ranges of (source, id, digest): each range is numbered alone and running totals of the ranges
    are added, so a hot source is spread. While a tree has several nodes, every ``arity``
    consecutive ones become one; the last run may have fewer. Trees ascend by source, null first;
    numbering them is one task with a row for each source. An empty table has the digest of the
    empty text as its root and no trees.
    """
    spark = docs.sparkSession
    store = shared_path(spark, "merkle")
    narrow = docs.select(
        quoted(source_col).cast("string").alias("source"),
        quoted(id_col).alias("id"),
        digest_of(leaf_text([quoted(f) for f in fields])).alias("digest"),
        F.struct(F.lit(0).alias("none"), *[c.alias(n) for n, c in keep.items()]).alias("kept"),
    )
    narrow = settled(narrow, "merkle-rows")
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest")]
    ranged = settled(
        narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "merkle-ranges"
    )
    counts = ranged.groupBy("source", "part").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("source").alias("of"),
        F.col("part").alias("in"),
        F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"),
        F.sum("m").over(Window.partitionBy("source")).alias("n"),
    )
    sources = counts.groupBy("of").agg(F.max("n").alias("n")).select(
        F.col("of").alias("source"),
        "n",
        depth_of(F.col("n"), arity).alias("depth"),
        (F.row_number().over(Window.orderBy(F.col("of").asc_nulls_first())) - 1).cast("long").alias("tree"),
    )
    sources = settled(sources, "merkle-sources")
    offsets = counts.join(sources, F.col("of").eqNullSafe(F.col("source"))).select("of", "in", "before", "tree", "depth")
    inside = Window.partitionBy("part", "source").orderBy(F.col("id").asc_nulls_first(), "digest")
    numbered = ranged.withColumn("place", F.row_number().over(inside) - 1)
    leaves = numbered.join(
        offsets, (F.col("part") == F.col("in")) & F.col("source").eqNullSafe(F.col("of"))
    ).select("tree", (F.col("place") + F.col("before")).alias("at"), "depth", "id", "digest", "kept")
    leaves = settled(leaves, "merkle-leaves")

    shape = sources.agg(F.max("depth"), F.count("*")).first()
    depth, trees = shape[0] or 0, shape[1]
    roots = _grow(leaves.select("tree", "at", "depth", "digest"), depth, f"{store}/level", arity)
    trees_table = settled(sources.join(roots, "tree").select("tree", "source", "n", "depth", "digest"), "merkle-trees")
    above = spark.range(1).select(depth_of(F.lit(trees), arity)).first()[0]
    top = trees_table.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(above).alias("depth"), "digest"
    )
    last = _grow(top, above, f"{store}/top", arity)
    found = last.select(as_hex(F.col("digest"))).first() if trees else None
    root = found[0] if found else spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    return Manifest(leaves, trees_table, root, depth, above, store, arity)


def _step(frontier: DataFrame, records: DataFrame, arity: int) -> DataFrame:
    """Descend one level: every row (tree, at, digest, subroot, path) becomes one for each child."""
    known = records.select("digest", "children").dropDuplicates(["digest"])
    opened = frontier.join(known, "digest").select(
        "tree", "at", "subroot", "path", "children", F.posexplode("children").alias("digit", "child")
    )
    others = F.concat(
        F.slice("children", F.lit(1), F.col("digit")),
        F.slice("children", F.col("digit") + 2, F.size("children") - F.col("digit") - 1),
    )
    segment = F.struct(F.col("digit").cast("int").alias("digit"), others.alias("others"))
    return opened.select(
        "tree",
        (F.col("at") * arity + F.col("digit")).alias("at"),
        F.col("child").alias("digest"),
        "subroot",
        F.concat("path", F.array(segment)).alias("path"),
    )


def _asked(frontier: DataFrame, requests: DataFrame | None, of: Column, arity: int, level: int) -> DataFrame:
    """Only the nodes above a requested leaf."""
    if requests is None:
        return frontier
    wanted = requests.select(of.alias("tree"), F.expr(f"CAST(at div {arity**level} AS BIGINT)").alias("at")).distinct()
    return frontier.join(wanted, ["tree", "at"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """(tree, at, digest, subroot, path) of the requested leaves, a table (tree, at) of ranks; all
    leaves without it.

    Requests descend together: those that share a prefix of their digits are one row until they
    part, so the descent reads each level of the store once. ``path`` is the reversed path, from
    the leaf to the root: (digit, others), the selected child's place and the digests of the
    unselected ones. Equal requests give one row; ranks that do not exist give none.
    """
    spark = manifest.trees.sparkSession
    arity = manifest.arity
    none = F.array().cast(_PATH)
    start = spark.createDataFrame([(0, 0, bytes.fromhex(manifest.root))], "tree long, at long, digest binary")
    frontier = start.withColumns({"subroot": F.lit(None).cast("binary"), "path": none})
    if manifest.trees.isEmpty():
        frontier = frontier.where(F.lit(False))
    for level in range(manifest.top_depth, 0, -1):
        frontier = _step(frontier, spark.read.parquet(f"{manifest.store}/top={level}"), arity)
    # A rank among the sources is the number of a source's tree.
    at_root = frontier.select(F.col("at").alias("tree"), "digest", "path")
    begin = settled(at_root.join(manifest.trees.select("tree", "depth"), "tree"), "merkle-begin")
    entry = lambda level: begin.where(F.col("depth") == level).select(
        "tree", F.lit(0).cast("long").alias("at"), "digest", F.col("digest").alias("subroot"), "path"
    )
    of = F.col("tree")
    frontier = _asked(entry(manifest.depth), requests, of, arity, manifest.depth)
    for level in range(manifest.depth, 0, -1):
        frontier = _step(frontier, spark.read.parquet(f"{manifest.store}/level={level}"), arity)
        frontier = frontier.unionByName(entry(level - 1))
        frontier = _asked(frontier, requests, of, arity, level - 1)
        if (manifest.depth - level) % STEPS_PER_TABLE == STEPS_PER_TABLE - 1:
            frontier = settled(frontier, "merkle-descent")
    return frontier.withColumn("path", F.reverse("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the segments of its path give, as hex."""

    def up(held, segment):
        left = F.slice(segment["others"], F.lit(1), segment["digit"])
        right = F.slice(segment["others"], segment["digit"] + 1, F.size(segment["others"]) - segment["digit"])
        return F.sha2(F.concat(joined_hex(left), held, joined_hex(right)), 256)

    return F.aggregate(path, leaf, up)


def proof_text(path: Column) -> Column:
    """The unselected digests from the leaf to the root as hex, without separators."""
    return F.array_join(F.transform(path, lambda s: joined_hex(s["others"])), "")


def audit(
    docs: DataFrame,
    claimed: Column | None = None,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    arity: int = ARITY,
) -> DataFrame:
    """A proof for every row: (id, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``claimed`` is the digest (hex) of what is to be verified for a row, by default its own leaf;
    it is folded with the original siblings and compared with the root. See ``build`` for nulls,
    ties and empty tables; a row whose claim is null counts with its own leaf.
    """
    own = F.sha2(leaf_text([quoted(f) for f in fields]), 256)
    claim = own if claimed is None else F.coalesce(claimed, own)
    made = build(docs, fields, id_col, source_col, arity, claim=F.unhex(claim))
    proofs = prove(made).select("tree", "at", "subroot", "path")
    rows = made.leaves.join(proofs, ["tree", "at"])
    done = folded(as_hex(F.col("kept.claim")), F.col("path"))
    return rows.select(
        "id",
        as_hex(F.col("digest")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        F.lit(made.root).alias("root"),
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        done.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf(fields: Sequence[str] = FIELDS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row whose text lost its line ends where 2 divides the CRC-32 of its id."""
    hit = F.crc32(quoted(id_col).cast("string").cast("binary")) % 2 == 0
    text = quoted(text_col).cast("string")
    changed = F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    return F.sha2(leaf_text([changed if f == text_col else quoted(f) for f in fields]), 256)
