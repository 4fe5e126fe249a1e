"""Token counts as delta-maintained rollups with idempotent batch commits.

A store is a folder with three append-only parts. ``ledger`` has the signed entries of documents
(+1 document and its tokens, or the reverse of an earlier entry) in buckets by a hash of the
document, ``deltas`` their sums by source, language and tokenizer version, ``commits`` one numbered
file for each commit, which names a batch and the attempt that wrote its entries. A commit file is
made once and never replaced, so the order of commits cannot change: a batch counts by its first
commit, a batch that is sent again changes nothing, and of two batches that commit at once the later
one sees the other's number taken and is computed again over the new state. Entries of attempts
without a commit file never count. Totals are sums of the small ``deltas``; a batch reads only the
ledger's buckets that hold its documents.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskgrove.llm.common import quoted, settled, text_of

LEDGER = "batch string, attempt string, doc_id string, source string, lang string, version string, docs long, tokens long, bucket int"
DELTAS = "batch string, attempt string, source string, lang string, version string, docs long, tokens long"
COMMITS = "number long, batch string, attempt string"
GROUP = ["source", "lang", "version"]

#: Buckets of a ledger. A store keeps the number it was created with.
BUCKETS = 64


def measured(
    docs: DataFrame, versions: Mapping[str, Column], id_col: str = "doc_id",
    source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """Changes that put the counts of all documents: a row for each document and version.

    ``versions`` maps a tokenizer version to its count, an expression over ``docs``.
    """
    counts = F.array(*[F.struct(F.lit(v).alias("version"), c.cast("long").alias("tokens")) for v, c in versions.items()])
    return docs.select(
        F.lit("put").alias("op"),
        quoted(id_col).cast("string").alias("doc_id"),
        quoted(source_col).cast("string").alias("source"),
        quoted(lang_col).cast("string").alias("lang"),
        F.inline(counts),
    )


def removed(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Changes that delete documents in all versions."""
    none = F.lit(None).cast("string")
    return ids.select(
        F.lit("delete").alias("op"), quoted(id_col).cast("string").alias("doc_id"),
        none.alias("source"), none.alias("lang"), none.alias("version"), F.lit(None).cast("long").alias("tokens"),
    )


class Store:
    """``buckets`` counts for a new store only; about the documents of a usual batch is a good number."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def create(self) -> Store:
        """Make an empty store; one that exists stays as it is."""
        self.spark.createDataFrame([], LEDGER).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/ledger")
        self.spark.createDataFrame([], DELTAS).write.mode("append").parquet(f"{self.path}/deltas")
        self._publish("settings", {"buckets": self.buckets})
        return self

    def _publish(self, name: str, content: dict) -> bool:
        """Write a small file unless it exists: a new file takes the name without replacing another."""
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs
        target = fs.Path(f"{self.path}/{name}.json")
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if system.exists(target):
            return False
        draft = fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        system.mkdirs(target.getParent())
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = fs.FileContext.getFileContext(system.makeQualified(target).toUri(), self.spark._jsc.hadoopConfiguration())
        never_replace = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(system.makeQualified(draft), system.makeQualified(target), never_replace)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def commits(self) -> DataFrame:
        """Rows (number, batch, attempt) of all commits."""
        files = self.spark.read.schema(COMMITS).option("pathGlobFilter", "*.json")
        try:
            return files.json(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # no commit yet
                raise
            return self.spark.createDataFrame([], COMMITS)

    def committed(self) -> DataFrame:
        """The attempt that counts for each batch: that of its first commit."""
        first = F.min(F.struct("number", "attempt"))["attempt"]
        return self.commits().groupBy("batch").agg(first.alias("attempt"))

    def _counting(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema).join(self.committed(), ["batch", "attempt"])

    def _bucket(self) -> Column:
        kept = self.spark.read.schema("buckets int").json(f"{self.path}/settings.json").first()["buckets"]
        return F.pmod(F.xxhash64("doc_id"), F.lit(kept)).cast("int")

    def current(self, buckets: list[int] | None = None) -> DataFrame:
        """Counts of all documents, or of some buckets, as of now: rows (doc_id, version, source,
        lang, docs, tokens)."""
        entries = self._counting("ledger", LEDGER)
        if buckets is not None:  # whole folders of the ledger are left out
            entries = entries.where(F.col("bucket").isin(buckets))
        entries = entries.groupBy("doc_id", "version", "source", "lang")
        sums = entries.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes once; False if the batch was committed before.

        ``put`` sets the count of a document and version, whether new or revised, ``delete``
        takes a document out in all versions. A count that stands in the store is reversed by a
        signed entry first. Of several puts for one document and version in a batch the largest
        (tokens, source, lang) counts; a put beside a delete of the same document stands.
        Deletes of unknown documents, changes without id and puts without version change
        nothing; null tokens count as 0, null source and language are groups of their own. An empty
        batch is a commit without entries.
        """
        changes = changes.where(F.col("doc_id").isNotNull())
        value = F.struct(F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"), "source", "lang")
        puts, gone = None, None
        while True:
            taken = self.commits().agg(F.max("number"), F.count_if(F.col("batch") == batch)).first()
            if taken[1]:
                return False
            if puts is None:
                bucket = self._bucket()
                puts = changes.where("op = 'put' AND version IS NOT NULL")
                puts = puts.groupBy("doc_id", "version").agg(F.max(value).alias("v")).withColumn("bucket", bucket)
                puts = settled(puts, "token-puts")
                gone = changes.where("op = 'delete'").select("doc_id").distinct().withColumn("bucket", bucket)
                gone = settled(gone, "token-deletes")
            number = 0 if taken[0] is None else taken[0] + 1
            attempt = self._write(batch, puts, gone)
            if self._publish(f"commits/{number:012d}", {"number": number, "batch": batch, "attempt": attempt}):
                return True

    def _write(self, batch: str, puts: DataFrame, gone: DataFrame) -> str:
        """Write the entries of a batch over the state as of now; the attempt's name."""
        attempt = uuid.uuid4().hex
        new = puts.select("doc_id", "v.source", "v.lang", "version", F.lit(1).cast("long").alias("docs"), "v.tokens")
        # at most as many rows as the store has buckets
        touched = [r[0] for r in puts.select("bucket").union(gone.select("bucket")).distinct().collect()]
        standing = self.current(touched)
        gone = gone.select("doc_id")
        by_delete = standing.join(gone, "doc_id", "left_semi")
        by_put = standing.join(gone, "doc_id", "left_anti").join(puts, ["doc_id", "version"], "left_semi")
        old = by_delete.unionByName(by_put)
        old = old.withColumn("docs", -F.col("docs")).withColumn("tokens", -F.col("tokens"))

        names = ["batch", "attempt", "doc_id", *GROUP, "docs", "tokens", "bucket"]
        marked = {"batch": F.lit(batch), "attempt": F.lit(attempt), "bucket": self._bucket()}
        entries = new.unionByName(old.select(new.columns)).withColumns(marked).select(names)
        # the entries of a bucket come from one task, or from some where they are many
        entries = entries.hint("rebalance", "bucket")
        entries.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/ledger")
        written = self._read("ledger", LEDGER).where(F.col("bucket").isin(touched))
        written = written.where((F.col("batch") == batch) & (F.col("attempt") == attempt))
        sums = written.groupBy("batch", "attempt", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("append").parquet(f"{self.path}/deltas")
        return attempt

    def totals(self) -> DataFrame:
        """Rows (source, lang, version, docs, tokens) of all groups with documents."""
        sums = self._counting("deltas", DELTAS).groupBy(*GROUP)
        sums = sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))


def pattern_count(text_col: str, pattern: str) -> Column:
    """Matches of a pattern in a text, as a tokenizer version (null: 0)."""
    return F.regexp_count(text_of(text_col), F.lit(pattern)).cast("long")
