"""Chat formatting by quotation linking: quotes are parsed, joined to their originals and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskgrove.llm.common import boxed, lowered, may_hold, membership, quoted, settled, text_of, unboxed

#: The mark of a quoted line: any number of ``>``, each with spaces around.
QUOTE = r"^[ \t]*>[> \t]*"

#: Columns that ``link`` adds.
FOUND = ("own_text", "n_quotes", "reply_to", "thread", "position", "formatted")


def lines_of(text: Column) -> Column:
    """Array of (level, text) of all lines; the level counts the marks, 0 is the author's own."""
    mark = lambda line: F.regexp_extract(line, QUOTE, 0)
    return F.transform(
        F.split(text, r"\r?\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(mark(line), r"[^>]", "")).alias("level"),
            F.regexp_replace(line, QUOTE, "").alias("line"),
        ),
    )


def normalised(text: Column) -> Column:
    """A-Z lower-cased, white space as one space, trimmed."""
    return F.trim(F.regexp_replace(lowered(text), r"[\x20\x09-\x0D]+", " "))


def passages_of(lines: Column) -> Column:
    """Runs of consecutive lines of one level as (level, normalised text), in order.

    The places where runs begin and end are found first and each run is cut out once, so the work
    is in proportion to the lines. The lines are bound to a variable of a function, as an optimizer
    that moves a filter would compute them anew for every place otherwise.
    """
    return F.get(F.transform(F.array(lines), _runs), F.lit(0))


def _runs(lines: Column) -> Column:
    n = F.size(lines)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    level = lambda i: F.try_element_at(lines, i)["level"]
    begins = F.filter(places, lambda i: (i == 1) | (level(i) != F.when(i > 1, level(i - 1))))
    ends = F.filter(places, lambda i: (i == n) | (level(i) != level(i + 1)))

    def cut(run: Column) -> Column:
        own = F.slice(lines, run["begin"], run["end"] - run["begin"] + 1)
        text = F.array_join(F.transform(own, lambda x: x["line"]), "\n")
        return F.struct(level(run["begin"]).alias("level"), normalised(text).alias("line"))

    pairs = F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("begin"), e.alias("end")))
    return F.transform(pairs, cut)


def link(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Every message with ``own_text`` (without quoted lines), ``n_quotes`` (quoted passages),
    ``reply_to`` (turn of the quoted message), ``thread`` (first turn of its reply chain),
    ``position`` (messages of the thread before it) and ``formatted``. Sorting by conversation,
    ``thread`` and ``position`` gives the reply order back after the table was stored.

    A quoted passage is a run of lines of one quote level. Passages and their single lines are
    normalised and hashed; so are each message's own text and its own lines. The original of a
    passage is the first message of the conversation that has it as its own, if that is earlier.
    A message replies to the original of its outermost quotes: of whole passages before single
    lines, and the latest if there are several. A thread runs from a message without original
    through all replies; since a reply has a later turn than its original, threads in the order of
    turns are in reply order. ``formatted`` is the message with its role; a conversation is the
    sequence of these rows. It is never gathered into one value, so its length has no bound.
    Messages are not shuffled by conversation: passages meet originals by conversation and hash, so a
    conversation with a third of all messages is spread over all tasks.

    Null text counts as empty. Messages without conversation or turn have no links and no position.
    Rows of one conversation and turn are one message for links and positions; each row stays. An empty table gives an
    empty table. Columns named like the new ones are replaced.
    """
    lines = lines_of(text_of(text_col))
    rows = boxed(
        messages, conv=quoted(conv_col), turn=quoted(turn_col), role=quoted(role_col), lines=lines
    )
    own = F.filter("lines", lambda x: x["level"] == 0)
    quotes = F.filter(passages_of(F.col("lines")), lambda p: (p["level"] > 0) & (p["line"] != ""))
    own_text = F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"))
    rows = rows.select("row", "conv", "turn", "role", "lines", own_text.alias("own_text"), quotes.alias("quotes"))

    digest = lambda text: F.unhex(F.md5(text))
    single = lambda xs: F.transform(xs, lambda x: normalised(x["line"]))
    placed = rows.where("conv IS NOT NULL AND turn IS NOT NULL")
    whole = F.array(normalised(F.col("own_text")))
    units = F.array_distinct(F.concat(whole, single(F.filter("lines", lambda x: x["level"] == 0))))
    quoting = placed.where(F.size("quotes") > 0)
    of_lines = F.transform(
        F.filter("lines", lambda x: x["level"] > 0),
        lambda x: F.struct(x["level"].alias("level"), F.lit(1).alias("part"), normalised(x["line"]).alias("unit")),
    )
    of_passages = F.transform(
        "quotes", lambda p: F.struct(p["level"].alias("level"), F.lit(0).alias("part"), p["line"].alias("unit"))
    )
    asked = quoting.select("conv", "turn", F.inline(F.concat(of_passages, of_lines)))
    asked = asked.where("unit <> ''").select("conv", "turn", "level", "part", digest(F.col("unit")).alias("hash"))
    # only conversations with quotes look for originals, and only under hashes that are asked for
    asked = settled(asked, "chat-asked")
    wanted = membership(asked.select("conv"), "conv")
    known = membership(asked.select(F.xxhash64("conv", "hash").alias("key")), "key")
    places = placed.where(may_hold(wanted, F.col("conv")))
    first = places.select("conv", "turn", F.explode(units).alias("unit")).where("unit <> ''")
    first = first.select("conv", "turn", digest(F.col("unit")).alias("hash"))
    first = first.where(may_hold(known, F.xxhash64("conv", "hash")))
    first = first.groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    met = asked.join(first, ["conv", "hash"]).where("original < turn")
    best = F.min(F.struct("level", "part", (-F.col("original")).alias("original")))
    links = met.groupBy("conv", "turn").agg((-best["original"]).alias("reply_to"))
    threads = positions(chains(settled(links, "chat-links")))

    out = rows.alias("m").join(
        threads.withColumnsRenamed({"conv": "conv_", "turn": "turn_"}),
        (F.col("conv") == F.col("conv_")) & (F.col("turn") == F.col("turn_")),
        "left",
    )
    head = F.concat(F.lit("<|"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.lit("|>\n"))
    out = out.select(
        "row", "conv", "turn", "own_text", F.size("quotes").cast("long").alias("n_quotes"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("position", F.when(F.col("conv").isNotNull() & F.col("turn").isNotNull(), F.lit(0).cast("long"))).alias("position"),
        F.concat(head, F.col("own_text"), F.lit("\n")).alias("formatted"),
    )
    order = ["conv", "thread", "turn"]
    return unboxed(out.repartitionByRange(*order).sortWithinPartitions(*order), *FOUND)


def chains(links: DataFrame) -> DataFrame:
    """Rows (conv, turn, reply_to, thread) from links (conv, turn, reply_to): the first turn that
    each chain of replies leads to, by doubling the reach of each link in every round."""
    spans = links.withColumn("thread", F.col("reply_to"))
    while True:
        ahead = spans.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("next"))
        joined = spans.join(ahead, ["conv", "thread"], "left")
        moved = joined.select("conv", "turn", "reply_to", F.coalesce("next", "thread").alias("thread"), "next")
        moved = settled(moved, "chat-threads")
        spans = moved.drop("next")
        if moved.where("next IS NOT NULL").isEmpty():
            return spans


def positions(threads: DataFrame) -> DataFrame:
    """Add ``position``: 1 for the first reply of a thread in the order of turns, and so on.

    Replies are dealt into ranges; a place is the replies of the thread in the ranges before plus
    those before it in its own range, so no task holds a long thread as a whole.
    """
    ranged = threads.repartitionByRange("conv", "thread", "turn").withColumn("range", F.spark_partition_id())
    ranged = settled(ranged, "chat-ranges")
    thread = ["conv", "thread"]
    counts = ranged.groupBy(*thread, "range").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy(*thread).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*thread, "range", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*thread, "range").orderBy("turn")
    placed = ranged.withColumn("inside", F.row_number().over(inside)).join(before, [*thread, "range"])
    return placed.select("conv", "turn", "reply_to", "thread", (F.col("before") + F.col("inside")).cast("long").alias("position"))
