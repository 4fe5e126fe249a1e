"""Line dedup: levelled sorted runs of line hashes, merge-anti-joined and compacted.

A run is a table of line hashes and the number of documents that hold them, bucketed and sorted
by hash, so a later merge reads runs where they lie. Every batch of documents adds one run; runs
of a level are merged into one of the next level once there are enough of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskgrove.llm.common import boxed, lowered, may_hold, membership, quoted, settled, text_of, unboxed
from riskgrove.session import shared_path

#: Characters stripped at both ends of a line: space, tab to carriage return.
SPACE = " \t\n\x0b\f\r"

#: Documents that must hold a line before it is dropped, and characters that it must have.
MIN_DOCS = 10
MIN_CHARS = 1

#: Batches into which ``drop_common_lines`` deals the documents, and runs that make a level full.
BATCHES = 8
FANOUT = 4

#: A line in this share of a batch's (document, line) rows goes to all tasks; there are at most
#: ``batches / HOT_SHARE`` such lines, whatever the size of the table.
HOT_SHARE = 1e-4

#: Columns that ``drop_common_lines`` adds.
FOUND = ("n_lines", "n_dropped", "kept_text")

_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return lowered(F.btrim(line, F.lit(SPACE)))


def key_hash(key: Column) -> tuple[Column, Column]:
    """128 bits of a key: XXH64 under two seeds."""
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


class LineRuns:
    """The sorted runs of all batches seen so far.

    ``add`` takes one row for each line of a document: (doc, h1, h2), where ``doc`` tells
    documents apart; repeated rows of a document count once. Hashes that a run has already seen
    in ``min_docs`` documents are known as common: an anti-join by merge keeps them out of the
    batch's own run. Hashes are never null. An empty batch adds an empty run.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("a level needs at least two runs")
        self.spark = spark
        self.min_docs = min_docs
        self.fanout = fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []  # (table, folder) of each run

    @property
    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Add the run of one batch, then merge the levels that are full."""
        batch = keys.select("doc", *_KEY).distinct().groupBy(*_KEY).agg(F.count("*").alias("n"))
        for name, _ in self.runs:
            known = self.spark.table(name).where(F.col("n") >= self.min_docs)
            batch = batch.hint("merge").join(known.select(*_KEY), _KEY, "left_anti")
        self._put(batch, 0)

    def common(self) -> DataFrame:
        """(h1, h2, n) of hashes in at least ``min_docs`` documents; n counts no further than the
        batch that made the hash common."""
        return self._merged(self.runs).where(F.col("n") >= self.min_docs)

    def forget(self) -> None:
        """Take the runs out of the catalog; their files stay in the shared folder."""
        self._drop(self.runs)
        self.levels = []

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """The counts of several runs as one; read as plain files, since a union of bucketed tables
        may not be co-partitioned."""
        schema = "h1 long, h2 long, n long"
        if not runs:
            return self.spark.createDataFrame([], schema)
        return (
            self.spark.read.schema(schema)
            .parquet(*[folder for _, folder in runs])
            .groupBy(*_KEY)
            .agg(F.sum("n").alias("n"))
        )

    def _put(self, rows: DataFrame, level: int) -> None:
        name, folder = f"line_run_{uuid.uuid4().hex}", shared_path(self.spark, "line-run")
        (
            rows.repartition(self.buckets, *_KEY)
            .write.format("parquet")
            .bucketBy(self.buckets, *_KEY)
            .sortBy(*_KEY)
            .option("path", folder)
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, folder))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._merged(full), level + 1)
            self._drop(full)


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Every row with ``n_lines`` (before), ``n_dropped`` and ``kept_text``.

    A text is split at \\n. The key of a line is the line without white space at both ends, A-Z
    lower-cased. A key of at least ``min_chars`` characters that at least ``min_docs`` rows hold
    loses all its lines in every row; the other lines stay, joined by \\n. Rows are dealt by the
    hash of their id into batches for ``LineRuns``; only hashes and places of lines are counted
    and joined, and only rows whose text may hold a common line are shuffled.

    Null or empty text is one empty line, whose key is empty and stays with ``min_chars`` of 1 or
    more. Every row is a document, repeated rows and rows without id too. A text whose lines all
    go is empty. An empty table gives an empty table. Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    named = {"id": quoted(id_col), "t": F.xxhash64(text)}
    # The number of a row comes first: beside a generator it would number the exploded rows.
    rows = docs.select(
        *[c.alias(n) for n, c in named.items()],
        F.pmod(F.xxhash64(quoted(id_col)), F.lit(batches)).alias("batch"),
        F.monotonically_increasing_id().alias("doc"),
        text.alias("text"),
    )
    split = rows.select("id", "t", "batch", "doc", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keyed = split.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    h1, h2 = key_hash(F.col("key"))
    path = shared_path(spark, "lines")
    narrow = keyed.select("id", "t", "batch", "doc", "at", h1.alias("h1"), h2.alias("h2"))
    narrow.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(narrow.schema).parquet(path)

    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    common = settled(runs.common(), "common-lines")
    runs.forget()

    hot = common.where(F.col("n") >= F.greatest(F.lit(lines.count() * HOT_SHARE / batches), F.lit(min_docs)))
    rest = common.join(F.broadcast(hot), _KEY, "left_anti")
    own = lines.select("id", "t", "at", *_KEY)
    hits = own.join(F.broadcast(hot), _KEY, "left_semi").unionByName(
        own.join(F.broadcast(hot), _KEY, "left_anti").join(rest, _KEY, "left_semi")
    )
    drops = settled(hits.groupBy("id", "t").agg(F.collect_set("at").alias("gone")), "dropped-lines")

    held = may_hold(membership(drops.select("t"), "t"), F.xxhash64(text))
    rows = boxed(docs, **named, lines=F.split(text, "\n", -1), whole=text, held=held)
    n_lines = F.size("lines").cast("long").alias("n_lines")
    clear = rows.where(~F.col("held")).select(
        "row", n_lines, F.lit(0).cast("long").alias("n_dropped"), F.col("whole").alias("kept_text")
    )
    mine = (F.col("r.id").eqNullSafe(F.col("d.id"))) & (F.col("r.t") == F.col("d.t"))
    rest = rows.where("held").drop("whole").alias("r").join(drops.alias("d"), mine, "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    touched = rest.select("row", n_lines, F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return unboxed(clear.unionByName(touched), *FOUND)
