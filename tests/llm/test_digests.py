"""Centroids, Merkle manifests and line runs against brute force and odd tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrove.llm import centroids, lines, merkle
from tests.llm.odd import DOCS, NAMES, clashing, docs_of, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- centroids -----------------------------------------------------------------------------


def lloyd(rows, k, rounds, dims, steps):
    """Plain rounds over (id, vector) in whole numbers."""
    kept = [
        (i, [int(np.floor(steps * float(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(centres)), key=lambda c: (off(v, centres[c]), c)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    return sorted(
        ((i, c, off(v, centres[c])) for (i, v), c in zip(kept, own)), key=lambda r: (r[0] is None, r)
    ), centres


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_clusters_against_plain_rounds(spark):
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(6, 4))
    rows = [(i, (centre[i % 6] + draw.normal(size=4) * 0.4).tolist(), 0) for i in range(400)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5], 1)] * 3 + [(7, [0.5, 0.5, 0.5, 0.5], 1)] * 60
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * 3, 1), (903, [1.0, None, 1.0, 1.0], 1)]
    rows += [(904, [float("nan")] * 4, 1), (905, [float("inf"), 0.0, 0.0, 0.0], 1)]
    found, centres, scanned = centroids.cluster(vectors(spark, rows), k=8, rounds=12, dims=4, steps=16)
    want, plain = lloyd([(i, v) for i, v, _ in rows], 8, 12, 4, 16)
    mine = sorted(((r.id, r.cluster, r.distance) for r in found.collect()), key=lambda r: (r[0] is None, r))
    assert mine == want
    assert centres.astype(int).tolist() == plain
    # The bounds save work: later rounds scan only vectors whose gap has expired.
    assert scanned[0] == len(want) and sum(scanned[1:]) < 6 * len(want)


def test_ties_go_to_the_smaller_centroid():
    own, near, far = centroids.two_nearest(np.array([[1.0, 0.0]]), np.array([[2.0, 0.0], [0.0, 0.0], [9.0, 9.0]]))
    assert own.tolist() == [0] and near.tolist() == far.tolist() == [1.0]


def test_heaps_pop_only_expired_gaps():
    heap = [(1.0, 4), (2.0, 5), (9.0, 6)]
    assert centroids.expired(heap, 2.0) == [4, 5] and heap == [(9.0, 6)]


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.1, 0.2], 0), (2, [3.0, -3.0], 0)]
    found, centres, _ = centroids.cluster(vectors(spark, rows), k=5, rounds=2, dims=2)
    assert len(centres) == 2 and {r.distance for r in found.collect()} == {0}
    found, centres, _ = centroids.cluster(vectors(spark, rows).where("vec_id > 9"), k=5, dims=2)
    assert found.columns == ["id", "cluster", "distance"] and found.count() == 0 and len(centres) == 0


def test_clusters_ignore_other_columns_and_refuse_inexact_values(spark):
    rows = vectors(spark, [(1, [0.1, 0.2], 0)]).withColumns({"id": F.lit("x"), "own": F.lit(1), "a.b": F.lit(2)})
    assert centroids.cluster(rows, k=1, rounds=1, dims=2)[0].collect()[0].distance == 0
    with pytest.raises(Exception, match="would not be exact"):
        centroids.cluster(vectors(spark, [(1, [1e9, 0.0], 0)]), k=1, rounds=1, dims=2)


# ---- merkle --------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    out = ""
    for v in (row[0], row[3], row[2], row[4], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def climb(levels, place):
    """(left, right) siblings of each level from a leaf up."""
    for nodes in levels[:-1]:
        start = place // 3 * 3
        yield nodes[start:place], nodes[place + 1 : start + 3]
        place //= 3


def brute_audit(docs):
    trees = defaultdict(list)
    for row in docs:
        own, hit = leaf(row, row[1]), row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        changed = row[1].replace("\n", "") if hit and row[1] is not None else row[1]
        trees[row[3]].append((row[0] is not None, row[0] or 0, own, leaf(row, changed), row[0]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([r[2] for r in sorted(trees[s])]) for s in order}
    top = levels_of([built[s][-1][0] for s in order])
    out = []
    for number, s in enumerate(order):
        for place, (_, _, own, claim, doc) in enumerate(sorted(trees[s])):
            steps = [*climb(built[s], place), *climb(top, number)]
            held = claim
            for left, right in steps:
                held = sha("".join(left) + held + "".join(right))
            proof = sha("".join("".join(a) + "".join(b) for a, b in steps))
            out.append((doc, own, built[s][-1][0], top[-1][0], proof, held, held == top[-1][0]))
    return sorted(out, key=repr)


def many():
    rows = list(DOCS)
    for i in range(100, 187):
        rows.append((i, f"line {i}\n\nmore\n" if i % 3 else None, "en", ["a", "b", None, "lone é"][min(i % 5, 2)], i))
    return rows + [(500, "a\nb", None, "only", 3)]


def test_audit_against_brute_force(spark):
    rows = many()
    docs = spark.createDataFrame(rows, docs_of(spark).schema)
    found = merkle.audit(docs, merkle.tampered_leaf()).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_audit(rows)
    assert not all(r.verified for r in found) and any(r.verified for r in found)
    assert all(r.verified for r in merkle.audit(docs).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28])
def test_audit_of_small_trees(spark, n):
    rows = [(i, f"t\n{i}", "en", "one", i) for i in range(n)]
    docs = spark.createDataFrame(rows, docs_of(spark).schema)
    found = merkle.audit(docs, merkle.tampered_leaf()).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_audit(rows)


def test_requests_descend_together(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 2}", i) for i in range(60)]
    made = merkle.build(spark.createDataFrame(rows, docs_of(spark).schema))
    asked = spark.createDataFrame([(0, 5), (0, 5), (1, 29), (1, 999)], "tree long, at long")
    found = {(r.tree, r.at): r for r in merkle.prove(made, asked).collect()}
    assert set(found) == {(0, 5), (1, 29)}
    whole = {(r.tree, r.at): r for r in merkle.prove(made).collect()}
    assert len(whole) == 60 and all(whole[k] == r for k, r in found.items())


def test_manifest_of_empty_table_and_clashing_columns(spark):
    assert merkle.audit(empty(spark)).count() == 0
    assert merkle.build(empty(spark)).root == sha("")
    rows = clashing(spark, "digest", "at", "tree", "path", "kept", "id", "part")
    assert merkle.audit(rows).where("verified").count() == len(DOCS)


# ---- lines ---------------------------------------------------------------------------------


def brute_lines(rows, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    held = Counter(k for _, t in rows for k in {key(line) for line in (t or "").split("\n")} if k)
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        left = [line for line in every if held[key(line)] < min_docs]
        out.append((i, len(every), len(every) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def line_rows():
    rows = [(i, t) for i, t, *_ in DOCS]
    for i in range(20, 60):
        rows.append((i, f"own {i}\n  Common Line\t\nsecond common\n\nown {i}"))
    rows += [(60, "COMMON line\n" * 3 + "x"), (60, "COMMON line\n" * 3 + "x"), (61, "common line")]
    rows += [(62, "repeated here\n" * 40), (None, "common line\nnull id"), (63, " common line\r\n\n")]
    return rows + [(64, "\n".join(f"l{i}" for i in range(20_000)) + "\ncommon line\nl1")]


def test_lines_against_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for min_docs in (2, 10):
        found = lines.drop_common_lines(docs, min_docs=min_docs)
        mine = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()]
        assert sorted(mine, key=repr) == brute_lines(rows, min_docs)


def test_runs_give_the_same_in_any_number_of_batches(spark):
    keys = [(d, h % 7, h % 11) for d in range(60) for h in range(d % 9)]
    table = spark.createDataFrame(keys, "doc long, h1 long, h2 long")
    want = {k: n for k, n in Counter((a, b) for _, a, b in set(keys)).items() if n >= 10}
    for batches in (1, 5, 9):
        runs = lines.LineRuns(spark, min_docs=10, fanout=2, buckets=3)
        for b in range(batches):
            runs.add(table.where(F.col("doc") % batches == b))
        assert {(r.h1, r.h2) for r in runs.common().collect()} == set(want)
        assert len(runs.runs) == bin(batches).count("1")
        runs.forget()
    assert lines.LineRuns(spark).common().count() == 0


def test_a_common_hash_is_not_added_again(spark):
    table = spark.createDataFrame([(d, 1, 1) for d in range(12)] + [(99, 2, 2)], "doc long, h1 long, h2 long")
    runs = lines.LineRuns(spark, min_docs=10, fanout=4, buckets=2)
    runs.add(table)
    runs.add(table)
    assert [(r.h1, r.n) for r in spark.table(runs.runs[1][0]).collect()] == [(2, 1)]
    runs.forget()


def test_lines_of_empty_table_and_clashing_columns(spark):
    assert lines.drop_common_lines(empty(spark)).columns == [*NAMES, *lines.FOUND]
    assert lines.drop_common_lines(empty(spark)).count() == 0
    rows = clashing(spark, "id", "t", "lines", "row", "held", "gone", "n_lines")
    found = lines.drop_common_lines(rows)
    assert found.count() == len(DOCS) and found.columns[-3:] == list(lines.FOUND)
