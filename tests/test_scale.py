"""What keeps the preparation, clusterings and sinks small and quick on large tables."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskgrove.operators import centres, cluster, encode, split
from riskgrove.session import compile_wide
from riskgrove.sources import files


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_cells_of_cuts_meet_rows_where_they_are(no_broadcast):
    rows = no_broadcast.range(500).select((F.col("id") % 3).alias("label"), F.col("id").cast("string").alias("key"))
    assert "BroadcastHashJoin" in plan(split.cut_offs(rows, "label", "key", 0.2, 42))


def test_wide_projections_are_compiled(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        compile_wide(spark)
        assert spark.conf.get(name) == "8000"
        spark.conf.set(name, "123")
        compile_wide(spark)
        assert spark.conf.get(name) == "123"
    finally:
        spark.conf.set(name, before)


def test_numbers_scale_as_the_subquery(spark):
    rows = spark.createDataFrame([(1.0, 5, 2.0), (2.5, 5, None), (7.25, 5, -1.0)], "a double, b int, c double")
    cols = ["a", "b", "c"]
    got = encode.scale(rows, cols, encode.scaler_numbers(rows, cols)).collect()
    assert got == encode.standardise(rows, cols).collect()


def test_blocks_are_small_and_lossless():
    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(size=4_000), rng.integers(0, 5, 4_000), rng.integers(0, 900, 4_000), np.full(4_000, -0.0)], axis=1)
    block = centres.shut(x)
    assert np.array_equal(centres.opened(block).view(np.int64), x.view(np.int64)) and len(block) < 0.5 * x.nbytes
    one = np.array([[0.5, np.nan, -0.0]])
    assert np.array_equal(centres.opened(centres.shut(one)).view(np.int64), one.view(np.int64))


@pytest.mark.parametrize("rows", [5, 300, 5_000])
def test_cluster_sums_of_parts(rows):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(rows, 4)), np.zeros((3, 4))])
    models = [centres.Centres(k, s, centres.spread_starts(x, k, s)) for k in (2, 3) for s in (1, 2)]
    models.append(centres.Centres(3, 3, np.zeros((3, 4))))  # all centres equal: the first has all rows
    got = centres._cluster_sums(models)(x).reshape(-1, 7)
    at = 0
    for m in models:
        off = ((x[:, None, :] - m.centres) ** 2).sum(axis=2)
        own, low = off.argmin(axis=1), off.min(axis=1)
        for c in range(m.k):
            assert np.allclose(got[at + c, :4], x[own == c].sum(axis=0), atol=1e-9)
            assert np.allclose(got[at + c, 4:6], [(own == c).sum(), (x[own == c] ** 2).sum()])
        assert np.isclose(got[at : at + m.k, 6].sum(), low.sum())
        at += m.k


def test_moments_around_their_means():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3)) * [1, 5, 0.1] + [100, -3, 0]
    mixtures = [
        centres.Mixture(np.full(k, 1 / k), x[rng.integers(0, 700, k)], np.stack([np.cov(x.T)] * k)) for k in (2, 3)
    ]
    got = centres._moments(mixtures, None)(x)
    likely, cells, at = got[:2], got[2:].reshape(-1, 13), 0
    for i, m in enumerate(mixtures):
        logs = m.log_densities()(x)
        e = np.exp(logs)
        assert np.isclose(likely[i], np.log(e.sum(axis=1)).sum())
        share = e / e.sum(axis=1, keepdims=True)
        for c in range(m.k):
            off = x - m.means[c]
            want = np.concatenate([[share[:, c].sum()], share[:, c] @ off, ((off * share[:, c : c + 1]).T @ off).ravel()])
            assert np.allclose(cells[at], want, atol=1e-8)
            at += 1


def test_pca_of_all_rows_in_one_pass(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + [3, 0, -50]
    rows = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(5)
    vectors = rows.select(array_to_vector("x").alias("features"))
    small = np.array([r[0].toArray() for r in cluster.of_same_covariance(vectors).collect()])
    assert len(small) == 6 and np.allclose(np.cov(small.T), np.cov(x.T))
    _, parts = cluster.pca(vectors)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(parts, values[:2] / values.sum())


def test_attributions_are_not_sorted(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 1).select((F.col("id") % 3).cast("int").alias("class"), F.col("id").alias("row_id"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    files.write_attributions(rows, str(tmp_path / "t"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) in (before, "0")
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["class=0", "class=1", "class=2"]
    assert all("zstd" in p.name for p in (tmp_path / "t").rglob("part-*.parquet"))
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("class").count().count() == 3
