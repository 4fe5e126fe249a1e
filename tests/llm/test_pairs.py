"""Exact and near duplicates, mixing and decontamination against brute force and odd tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskgrove.llm import common, decontaminate, exact, fmindex, mixing, simhash
from tests.llm.odd import DOCS, NAMES, clashing, docs_of, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- exact ---------------------------------------------------------------------------------


def test_exact_groups_against_brute_force(spark):
    rows = exact.exact_groups(docs_of(spark)).toPandas()
    low = [(i, (t or "").translate(LOWER)) for i, t, *_ in DOCS]
    assert len(rows) == len(DOCS)
    for text in {t for _, t in low}:
        ids = [i for i, t in low if t == text]
        best = max((i for i in ids if i is not None), default=None)
        mine = rows[[(t or "").translate(LOWER) == text for t in rows["text"]]]
        assert set(mine["group_size"]) == {len(ids)}
        assert all((k == best) or (best is None and np.isnan(k)) for k in mine["keep_id"])
        assert mine["kept"].sum() == 1
        for digest in mine["text_hash"].dropna():
            assert bytes(digest) == hashlib.sha256(text.encode()).digest()


def test_exact_dedup_keeps_one_of_each(spark):
    kept = exact.exact_dedup(docs_of(spark))
    assert kept.columns == NAMES
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOWER) for _, t, *_ in DOCS})
    assert exact.exact_dedup(empty(spark)).count() == 0


def test_exact_keeps_clashing_columns(spark):
    rows = clashing(spark, "keep_id", "row", "hash", "start", "rows")
    kept = exact.exact_dedup(rows)
    assert kept.columns == rows.columns
    assert exact.exact_groups(rows).count() == rows.count()


def test_membership_has_no_false_negatives(spark):
    keys = spark.range(5000).withColumn("k", F.col("id") * 7919)
    held = common.membership(keys, "k")
    assert keys.where(~common.may_hold(held, F.col("k"))).count() == 0
    others = keys.withColumn("k", F.col("k") + 1)
    assert others.where(common.may_hold(held, F.col("k"))).count() < 50
    none = common.membership(keys.where("id < 0"), "k")
    assert keys.where(common.may_hold(none, F.col("k"))).count() == 0


def test_without_drops_only_named_ids(spark):
    gone = spark.createDataFrame([(1,), (None,), (99,)], "gone long")
    left = common.without(docs_of(spark), "doc_id", gone)
    assert left.columns == NAMES
    want = sorted(str(r[0]) for r in DOCS if r[0] != 1)
    assert sorted(str(r.doc_id) for r in left.collect()) == want


# ---- mixing --------------------------------------------------------------------------------


def water_filling(sizes: dict, most: float = 3.0) -> dict:
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        weights = sum(weight[s] for s in order if s not in capped)
        goal = {s: most * sizes[s] if s in capped else left * weight[s] / weights for s in order}
        above = {s for s in order if s not in capped and goal[s] > most * sizes[s] + 1e-9}
        if not above:
            return goal
        capped |= above


@pytest.mark.parametrize("per_range", [2, 1000])
def test_mix_gives_each_source_its_target(spark, per_range):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "é", "z", None]) if i > 5 else "tiny"
        rows.append((i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))), "en", source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, rows_per_range=per_range).toPandas()
    got["source"] = got["source"].where(got["source"].notna(), None)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    goal = water_filling(sizes)
    key = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    for source in sizes:
        own = got[[s == source for s in got["source"]]]
        assert np.allclose(own["target"], goal[source])
        assert own["taken"].sum() == round(goal[source])
        assert (own["taken"] <= 3 * own["size"]).all()
        words = round(goal[source])
        left = words - words // sizes[source] * sizes[source]
        for row in sorted(own.itertuples(), key=lambda r: key(r.doc_id)):
            share = min(max(left, 0), row.size)
            left -= row.size
            assert row.taken == words // sizes[source] * row.size + share


def test_mix_of_odd_tables(spark):
    got = mixing.mix(docs_of(spark)).toPandas()
    assert len(got) == len(DOCS) and (got["taken"] <= 3 * got["size"]).all()
    assert mixing.mix(empty(spark)).count() == 0
    blank = docs_of(spark).withColumn("text", F.lit(None).cast("string"))
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}
    rows = clashing(spark, "taken", "size", "key", "cut", "id")
    assert mixing.mix(rows).count() == rows.count()


# ---- decontamination -----------------------------------------------------------------------


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 5, 3000)
    text[1000:1500] = text[:500]
    index = fmindex.FMIndex(text)
    phrases = [text[i : i + n] for i, n in ((0, 10), (700, 3), (2990, 10), (5, 1))] + [np.array([4] * 9), np.array([9, 1])]
    table = np.zeros((len(phrases), 10), np.int64)
    for row, p in enumerate(phrases):
        table[row, : len(p)] = p
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    rows, owner = fmindex.ranges(low, high)
    found = index.locate(rows)
    for i, p in enumerate(phrases):
        want = [j for j in range(len(text) - len(p) + 1) if (text[j : j + len(p)] == p).all()]
        assert sorted(found[owner == i]) == want


def brute_contamination(text, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    own, hit, found = words(text), set(), set()
    for name, item in items:
        its = words(item)
        size = min(10, len(its))
        grams = {tuple(its[i : i + size]) for i in range(max(1, len(its) - 9))} if its else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(name)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes,shard_bytes", [(1 << 20, 1 << 20), (200, 300)])
def test_contamination_against_brute_force(spark, block_bytes, shard_bytes):
    rng = random.Random(7)
    word = lambda: rng.choice("aa bb cc dd ee Ff ñandú 12 x9".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(30)]
    items += [(3, "second row of item three"), (50, None), (51, ""), (None, "null item here"), (52, "solo")]
    docs = [(i, ", ".join(word() for _ in range(rng.randint(0, 80)))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "Solo"), (73, "x " * 3000 + items[4][1]), (73, "the null  ITEM here!")]
    rows = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        block_bytes=block_bytes, shard_bytes=shard_bytes,
    ).collect()
    named = [("" if i is None else str(i), t) for i, t in items]
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, found = brute_contamination(r.row.text, named)
        spans = [(s.start, s.end) for s in r.found.spans]
        assert (r.found.n_words, sum(b - a for a, b in spans), r.found["items"]) == (n, hit, found)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_decontaminate_odd_tables(spark):
    marks = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    kept = decontaminate.decontaminate(docs_of(spark), marks)
    assert kept.columns == NAMES
    assert kept.count() == sum("alpha beta gamma" not in (r[1] or "").lower() for r in DOCS)
    assert decontaminate.decontaminate(docs_of(spark), marks.limit(0)).count() == len(DOCS)
    assert decontaminate.decontaminate(empty(spark), marks).count() == 0
    rows = clashing(spark, "found", "row", "spans")
    assert decontaminate.decontaminate(rows, marks).columns == rows.columns


def test_spans_can_be_cut_out():
    text = "Keep this, Drop that now. keep"
    assert decontaminate.without_spans(text, [(2, 5)]) == "Keep this, . keep"


def test_texts_keep_their_clean_words(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [f"Before, {item.upper()}! After {item}.", "clean words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = dict(decontaminate.cut_out(docs, benchmark).collect())
    assert got == {0: "Before, ! After .", 1: "clean words", 2: "", 3: None}
    assert decontaminate.cut_out(docs.limit(0), benchmark).count() == 0


# ---- near duplicates -----------------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").translate(LOWER).encode().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints):
    root = list(range(len(fingerprints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fingerprints))]


@pytest.mark.parametrize("part_rows", [simhash.PART_ROWS, 3])
def test_near_groups_against_brute_force(spark, part_rows):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("la le lo mi ma mu".split()) + str(rng.randint(0, 40)) for _ in range(rng.randint(40, 300))) for _ in range(40)]
    rows = []
    for text in texts:
        rows.append(text)
        for _ in range(rng.randint(0, 4)):
            words = text.split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "edited"
            rows.append(" ".join(words))
    rows += [None, "", "one", "One", "two words", "a b c", " a  b\tc ", "\x1c \x85"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = simhash.near_groups(docs, part_rows=part_rows).toPandas().sort_values("id")
    want = [brute_fingerprint(t) for t in rows]
    assert [f % 2**64 for f in got["fingerprint"].tolist()] == want
    assert got["component_id"].tolist() == brute_components(want)


def test_links_of_dense_and_sparse_sets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [base]
    for _ in range(5):
        moved = base.copy()
        for _ in range(int(rng.integers(1, 5))):
            moved = moved ^ (np.uint64(1) << rng.integers(0, 64, len(moved)).astype(np.uint64))
        near.append(moved)
    values = np.unique(np.concatenate(near))
    want = brute_components([int(v) for v in values])
    place = {int(v): i for i, v in enumerate(values)}
    half = rng.random(len(values)) < 0.5
    for edges in (
        [simhash.linked(values)],
        [simhash.linked(values[half]), simhash.linked(values[~half]), simhash.linked(values[half], values[~half])],
    ):
        root = list(range(len(values)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = find(place[x]), find(place[y])
                root[max(x, y)] = min(x, y)
        assert [find(i) for i in range(len(values))] == want


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1000 + i) for i in range(1, 60)] + [(-5, 1030)]
    found = simhash.components(spark.createDataFrame(chain + hub, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len(found) == len(roots) == 41 + 61
    assert {roots[i] for i in range(41)} == {0} and {roots[n] for n in (1000, 1059, -5)} == {-5}


def test_near_dedup_odd_tables(spark):
    kept = simhash.near_dedup(docs_of(spark))
    assert kept.columns == NAMES
    assert None in {r.doc_id for r in kept.collect()}  # a row without id stays
    assert simhash.near_dedup(empty(spark)).count() == 0
    rows = clashing(spark, "id", "fingerprint", "row", "held", "gone")
    assert simhash.near_dedup(rows).columns == rows.columns
