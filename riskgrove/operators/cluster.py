"""Clustering, cluster quality and cluster profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.operators import centres
from riskgrove.operators.crosstab import group_means, row_shares
from riskgrove.operators.encode import min_max, standardise
from riskgrove.operators.ranks import attach_small
from riskgrove.operators.select import random_sample


def profile(rows: DataFrame, cluster: str = "cluster", digits: int = 2) -> DataFrame:
    """Risk moments, four means and the size of every cluster."""
    mean = lambda c: F.bround(F.avg(c), digits)
    return rows.groupBy(cluster).agg(
        mean("risk").alias("risk_mean"),
        F.bround(F.stddev_samp("risk"), digits).alias("risk_std"),
        F.bround(F.min("risk"), digits).alias("risk_min"),
        F.bround(F.max("risk"), digits).alias("risk_max"),
        mean("salary").alias("salary_mean"),
        mean("experience").alias("experience_mean"),
        mean("remote").alias("remote_mean"),
        mean("diversity").alias("diversity_mean"),
        F.count("*").alias("n"),
    )


def shares(rows: DataFrame, column: str, levels: list[str], cluster: str = "cluster") -> DataFrame:
    """Share of each level within each cluster: rounded to three decimals, then in percent."""
    table = row_shares(rows, [cluster], column, levels, digits=3)
    return table.withColumn(cluster, F.col("level").cast("int")).drop("dimension", "level")


def extreme_clusters(rows: DataFrame, value: str = "risk", cluster: str = "cluster") -> DataFrame:
    """The clusters with the highest and lowest mean."""
    means = rows.groupBy(cluster).agg(F.avg(value).alias("mean"))
    return means.agg(
        F.max_by(cluster, "mean").alias("highest"),
        F.max("mean").alias("highest_mean"),
        F.min_by(cluster, "mean").alias("lowest"),
        F.min("mean").alias("lowest_mean"),
    )


def radar(rows: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Cluster means scaled to [0, 1] across clusters."""
    return min_max(group_means(rows, cluster, cols), cols)


def spread_within(rows: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Size, centre and summed squared distance to the centre, per cluster, in one pass."""
    n = F.count("*").cast("double")
    inside = sum((F.var_pop(c) for c in cols), F.lit(0.0)) * n
    return rows.groupBy(label).agg(
        n.alias("n"), inside.alias("ss"), *[F.avg(c).alias(c) for c in cols]
    )


def inertia(rows: DataFrame, cols: list[str], label: str) -> DataFrame:
    return spread_within(rows, cols, label).agg(F.sum("ss").alias("inertia"))


def calinski_harabasz(rows: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Spread between cluster centres over spread within, per degree of freedom."""
    parts = spread_within(rows, cols, label)
    centre = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    between = sum(
        (F.sum(F.col(c) * F.col(c) * F.col("n")) - F.sum("n") * centre(c) * centre(c) for c in cols),
        F.lit(0.0),
    )
    k = F.count("*")
    return parts.agg(
        F.try_divide(between * (F.sum("n") - k), F.sum("ss") * (k - 1)).alias("calinski_harabasz")
    )


def davies_bouldin(rows: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Mean over clusters of the worst ratio of summed radii to centre distance."""
    centres = rows.groupBy(label).agg(*[F.avg(c).alias(f"__{c}") for c in cols])
    off = sum((F.pow(F.col(c) - F.col(f"__{c}"), 2) for c in cols), F.lit(0.0))
    radii = (
        attach_small(rows.select(label, *cols), centres, [label])
        .groupBy(label)
        .agg(F.avg(F.sqrt(off)).alias("radius"), F.array(*[F.first(f"__{c}") for c in cols]).alias("centre"))
    )
    # One row holds the k centres; the pairs are k * k.
    table = radii.agg(F.collect_list(F.struct(label, "radius", "centre")).alias("t"))
    pairs = table.select("t", F.explode("t").alias("a")).select("a", F.explode("t").alias("b"))
    apart = F.sqrt(
        sum((F.pow(F.col("a.centre")[i] - F.col("b.centre")[i], 2) for i in range(len(cols))), F.lit(0.0))
    )
    ratio = F.try_divide(F.col("a.radius") + F.col("b.radius"), apart)
    worst = (
        pairs.where(F.col(f"a.{label}") != F.col(f"b.{label}"))
        .groupBy(F.col(f"a.{label}").alias(label))
        .agg(F.max(ratio).alias("worst"))
    )
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def sampled_silhouette(
    rows: DataFrame, cols: list[str], label: str, key: str, n: int = 5000, seed: int = 42
) -> DataFrame:
    """Mean Euclidean silhouette of a repeatable sample of n rows.

    The sample has a fixed size, so every task may hold it; each task scores its share.
    """
    spark = rows.sparkSession
    picked = random_sample(rows.select(key, label, *cols), key, n, seed).toPandas()
    points = picked[cols].to_numpy(dtype="float64")
    labels, codes = np.unique(picked[label].to_numpy(), return_inverse=True)
    sizes = np.bincount(codes, minlength=len(labels)).astype("float64")
    shared = spark.sparkContext.broadcast((points, codes, sizes))

    def score(batches):
        points, codes, sizes = shared.value
        member = np.eye(len(sizes))[codes]
        for batch in batches:
            at = batch["at"].to_numpy()
            gaps = np.sqrt(((points[at][:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
            sums = gaps @ member
            own = codes[at]
            here = np.arange(len(at))
            inner = sums[here, own] / np.maximum(sizes[own] - 1, 1)
            others = sums / sizes
            others[here, own] = np.inf
            outer = others.min(axis=1)
            top = np.maximum(inner, outer)
            value = np.divide(outer - inner, top, out=np.zeros_like(top), where=top > 0)
            yield pd.DataFrame({"s": np.where(sizes[own] > 1, value, 0.0)})

    tasks = min(spark.sparkContext.defaultParallelism, max(1, len(points) // 64))
    at = spark.range(0, len(points), 1, tasks).select(F.col("id").alias("at"))
    return at.mapInPandas(score, "s double").agg(F.avg("s").alias("silhouette"))


def assemble(rows: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out).transform(rows)


def scaled_vectors(rows: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """Standardised columns as one vector."""
    return assemble(standardise(rows.select(*keep, *cols), cols), cols).select(*keep, "features")


def of_same_covariance(vectors: DataFrame) -> DataFrame:
    """A few vectors with the covariance of all; the given ones if it isn't finite.

    One pass sums the products; Spark's own fit passes twice and adds row by row.
    """
    n, _, products = centres.products(vectors)
    if n < 2 or not np.isfinite(products).all():
        return vectors
    values, axes = np.linalg.eigh(products / (n - 1))
    root = (axes * np.sqrt(np.maximum(values, 0.0))) @ axes.T
    root *= np.sqrt(len(root) - 0.5)
    records = [(Vectors.dense(row),) for row in np.concatenate([root, -root])]
    return vectors.sparkSession.createDataFrame(records, ["features"])


def pca(vectors: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Scores pc1..pck of centred vectors, and the share of variance each explains."""
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(of_same_covariance(vectors))
    scores = model.transform(vectors).withColumn("__pc", vector_to_array("pc"))
    named = {f"pc{i + 1}": F.col("__pc")[i] for i in range(k)}
    shares_of = [float(v) for v in model.explainedVariance.toArray()]
    return scores.withColumns(named).drop("pc", "__pc"), shares_of


def start_sample(vectors: DataFrame, rows: int = centres.START_ROWS) -> np.ndarray:
    """A repeatable sample of fixed size, from which starts are chosen."""
    hashed = vectors.select(vector_to_array("features").alias("x")).withColumn("h", F.xxhash64("x"))
    found = hashed.orderBy("h", "x").limit(rows).select("x").toArrow().column("x").combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1)


def fit_kmeans_sweep(vectors: DataFrame, ks: list[int], seeds: list[int], max_iter: int = 300) -> centres.Sweep:
    """The best of several starts for each k; all of them share each pass over the vectors."""
    blocks = centres.packed(vectors)
    try:
        return centres.kmeans_sweep(blocks, start_sample(vectors), ks, seeds, max_iter)
    finally:
        blocks.unpersist()


def kmeans_table(spark, sweep: centres.Sweep) -> DataFrame:
    return spark.createDataFrame(
        sweep.records, "k int, inertia double, silhouette double, calinski_harabasz double"
    )


def kmeans_sweep(vectors: DataFrame, ks: list[int], seeds: list[int], max_iter: int = 300) -> DataFrame:
    """(k, inertia, silhouette, calinski_harabasz) of the best start per k.

    The silhouette is over all rows with squared Euclidean distance.
    """
    return kmeans_table(vectors.sparkSession, fit_kmeans_sweep(vectors, ks, seeds, max_iter))


def information_criteria(log_likelihood: float, k: int, dims: int, n: int) -> tuple[float, float]:
    """(BIC, AIC) of a full-covariance mixture."""
    free = k * dims + k * dims * (dims + 1) // 2 + k - 1
    return -2 * log_likelihood + free * float(np.log(n)), -2 * log_likelihood + 2 * free


def fit_gmm_sweep(
    vectors: DataFrame, ks: list[int], seed: int = 42, max_iter: int = 100
) -> dict[int, centres.Mixture]:
    """A mixture for each number of components, from k-means with ten starts; shared passes."""
    blocks = centres.packed(vectors)
    try:
        found = centres.kmeans_sweep(blocks, start_sample(vectors), ks, [*range(seed, seed + 10)])
        return dict(zip(ks, centres.gmm_sweep(blocks, [found.models[k].centres for k in ks], max_iter)))
    finally:
        blocks.unpersist()


def gmm_table(vectors: DataFrame, mixtures: dict[int, centres.Mixture]) -> DataFrame:
    """(k, log_likelihood, bic, aic) per number of components."""
    n = vectors.count()
    records = [
        (k, m.log_likelihood, *information_criteria(m.log_likelihood, k, m.means.shape[1], n))
        for k, m in mixtures.items()
    ]
    return vectors.sparkSession.createDataFrame(
        records, "k int, log_likelihood double, bic double, aic double"
    )


def gmm_sweep(vectors: DataFrame, ks: list[int], seed: int = 42, max_iter: int = 100) -> DataFrame:
    return gmm_table(vectors, fit_gmm_sweep(vectors, ks, seed, max_iter))
