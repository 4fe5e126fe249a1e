"""Secret scans: fixed patterns, and strings that a primed zstandard compressor finds new."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from riskgrove.llm.common import plain_strings, quoted, text_of

# The patterns of the three base kinds, in the order in which they are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive, and how far in front of a string they may stand.
SENSITIVE = (
    "key secret token passw pwd auth credential bearer private signature".split()
)
REACH = 48

#: A novel string is this long, has letters and digits, and adds this many compressed bytes for
#: each of its characters to its surroundings.
NOVEL_LENGTH = 16
NOVEL_SHARE = 0.6

#: Characters on both sides that prime the compressor, and identifiers in its dictionary.
AROUND = 256
IDENTIFIERS = 4096

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("novelty", T.DoubleType()),
        ]
    )
)
SPANS_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])
)

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")  # the runs of HEX that are long enough
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{NOVEL_LENGTH},}}={{0,2}}")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)
_BEFORE = re.compile(rb"([A-Za-z_][A-Za-z0-9_]{1,63})[ \t]*$")
_CODE = re.compile(rb"[=(]")
_HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def base_spans(text: str, raw: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds in code points; ``raw`` is the text in UTF-8.

    Cheap looks at the bytes decide whether a pattern can match at all.
    """
    found = []
    low = raw.lower()
    if any(word in low for word in (b"passw", b"secret", b"token", b"api")):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                found.append((m.start(), "assign", m.end()))
    if b"AKIA" in raw:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                found.append((m.start(), "access", m.end()))
    if b"h" * LEAST["hex"] in raw.translate(_HEX_BYTES):
        found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


def _without(text: str, start: int, end: int, own: str, least: int, most: int) -> str:
    """``text[start:end]`` without the copies of a string, which may stick out of it but lie in
    ``text[least:most]``."""
    pieces, at = [], start
    copy = text.find(own, max(least, start - len(own) + 1), min(most, end + len(own) - 1))
    while copy >= 0:
        pieces.append(text[at : max(at, copy)])
        at = copy + len(own)
        copy = text.find(own, at, min(most, end + len(own) - 1))
    return "".join(pieces) + text[at:end]


class Novelty:
    """Marginal compressed bytes of a string against its surroundings and a dictionary."""

    def __init__(self, identifiers: list[str]):
        words = "\n".join(identifiers).encode()
        raw = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if words else None
        self.packer = zstandard.ZstdCompressor(
            level=9, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def share(self, text: str, start: int, end: int) -> float:
        """Bytes that the string adds, for each of its bytes; copies of it nearby don't count."""
        own = text[start:end]
        before = _without(text, max(0, start - AROUND), start, own.rstrip("="), 0, start)
        after = _without(text, end, end + AROUND, own.rstrip("="), end, len(text))
        around = (before + after).encode("utf-8", "surrogatepass")
        whole = (before + after + own).encode("utf-8", "surrogatepass")
        more = len(self.packer.compress(whole)) - len(self.packer.compress(around))
        return more / len(own)

    def spans(self, text: str, raw: bytes, known: list[tuple[int, str, int]]) -> list[tuple[int, str, int, float]]:
        """Novel strings behind a sensitive word, other than whole known spans."""
        low = raw.lower()
        whole = {(start, end) for start, _, end in known}
        if not any(word.encode() in low for word in SENSITIVE):
            return []
        found = []
        for m in _CANDIDATE.finditer(text):
            start, end = m.span()
            if not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
                continue
            if (start, end) in whole:
                continue
            if not _SENSITIVE.search(text, max(0, start - REACH), start):
                continue
            share = self.share(text, start, end)
            if share >= NOVEL_SHARE:
                found.append((start, "novel", end, share))
        return found


def _identifier_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names in front of ``=`` or ``(``, counted for each batch."""
    for batch in batches:
        names: Counter[bytes] = Counter()
        for raw in plain_strings(batch.column("text")).cast(pa.binary()).to_pylist():
            for m in _CODE.finditer(raw):
                name = _BEFORE.search(raw, max(0, m.start() - 80), m.start())
                if name:
                    names[name[1]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([n.decode() for n in names], pa.string()), pa.array(list(names.values()), pa.int64())],
            names=["name", "n"],
        )


def identifiers(docs: DataFrame, text_col: str = "text", most: int = IDENTIFIERS) -> list[str]:
    """The most frequent identifiers of all texts, the most frequent last (``most`` is the size
    of the compressor's dictionary, so the list is bounded)."""
    rows = docs.select(text_of(text_col).alias("text")).mapInArrow(_identifier_batches, "name string, n long")
    top = rows.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(most)
    return [r["name"] for r in top.collect()][::-1]


def _scan_batches(batches: Iterator[pa.RecordBatch], names) -> Iterator[pa.RecordBatch]:
    novelty = Novelty(names.value)
    order = {kind: i for i, kind in enumerate(KINDS)}
    for batch in batches:
        texts = plain_strings(batch.column("text"))
        out = []
        for row, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
            text = raw.decode("utf-8", "surrogatepass")
            known = base_spans(text, raw)
            spans = [(s, order[k], e, None) for s, k, e in known]
            spans += [(s, order[k], e, x) for s, k, e, x in novelty.spans(text, raw, known)]
            spans.sort(key=lambda s: s[:3])
            out.append([{"kind": KINDS[k], "start": s, "end": e, "novelty": x} for s, k, e, x in spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(out, SPANS_ARROW)], names=["row", "spans"]
        )


def scan(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the columns in ``carry``, by default all) and ``spans`` for every row.

    A span has its kind, start and end in code points (end exclusive) and, if novel, the
    compressed bytes it adds for each byte. Base kinds are found by their patterns, leftmost and
    without overlap for each kind; short matches are dropped. A novel string stands behind a
    sensitive word, mixes letters and digits, is not itself a base span and hardly compresses
    against the text around it and the identifiers of the whole corpus. The value of an
    assignment can be novel: its span then lies in that of the assignment. Other copies of a string
    are taken out of the text around it, so each copy is as novel as a single one.

    Null and empty texts have no spans. Equal texts have equal spans. Spans are sorted by start,
    then kind. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    names = spark.sparkContext.broadcast(identifiers(docs, text_col))
    row = F.struct(*[quoted(c).alias(c) for c in carry or docs.columns]).alias("row")
    rows = docs.select(row, text_of(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("spans", SPANS)])
    return rows.mapInArrow(partial(_scan_batches, names=names), schema)
