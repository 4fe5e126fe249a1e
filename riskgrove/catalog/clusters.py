"""Clustering queries. Given labels make profile and quality operators exactly checkable."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskgrove.catalog.models import _once, matrix_scaler, prepared
from riskgrove.catalog.registry import over_jobs, r, register, rounded, sql_text
from riskgrove.functions.binning import cut
from riskgrove.operators import centres, cluster as C, crosstab as A, select as Q
from riskgrove.operators.common import distinct_levels
from riskgrove.operators.encode import scale, standardise
from riskgrove.sources import schema as S
from riskgrove.sources.tables import jobs

VECTOR = ["salary", "remote", "diversity", "risk"]
_LABELLED = ", labelled AS (SELECT *, experience % 4 AS cluster FROM jobs)"


def labelled(spark, sf_dir, *cols: str, heavy: bool = False):
    names = list(dict.fromkeys(["experience", *cols]))
    return jobs(spark, sf_dir, *names, heavy=heavy).withColumn("cluster", F.col("experience") % 4)


_E = lambda x: f"round_even({x}, 2) + 0e0"


@register(
    "a08_cluster_statistics",
    over_jobs(
        f"""{_LABELLED} SELECT cluster, {_E('avg(risk)')} AS risk_mean, {_E('stddev_samp(risk)')} AS risk_std,
        {_E('min(risk)')} AS risk_min, {_E('max(risk)')} AS risk_max, {_E('avg(salary)')} AS salary_mean,
        {_E('avg(experience)')} AS experience_mean, {_E('avg(remote)')} AS remote_mean,
        {_E('avg(diversity)')} AS diversity_mean, count(*) AS n FROM labelled GROUP BY cluster"""
    ),
)
def cluster_statistics(spark, sf_dir):
    return C.profile(labelled(spark, sf_dir, "risk", "salary", "remote", "diversity"))


_INDUSTRIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _shares_sql(column: str, levels: list[str]) -> str:
    cells = ", ".join(
        r(f"round_even(count(CASE WHEN {column} = {sql_text(x)} THEN 1 END) * 1e0 / count(*), 3) * 100") + f' AS "{x}"'
        for x in levels
    )
    return over_jobs(f"{_LABELLED} SELECT cluster, {cells} FROM labelled GROUP BY cluster")


@register("a09_cluster_industry", _shares_sql("industry", _INDUSTRIES))
def cluster_industry(spark, sf_dir):
    rows = labelled(spark, sf_dir, "industry")
    return rounded(C.shares(rows, "industry", distinct_levels(rows, "industry")))


@register("a10_cluster_impact", _shares_sql("ai_impact", S.IMPACT_ORDER))
def cluster_impact(spark, sf_dir):
    return rounded(C.shares(labelled(spark, sf_dir, "ai_impact"), "ai_impact", S.IMPACT_ORDER))


@register(
    "a11_extreme_clusters",
    over_jobs(
        f"""{_LABELLED}, m AS (SELECT cluster, avg(risk) AS mean FROM labelled GROUP BY cluster)
        SELECT arg_max(cluster, mean) AS highest, {r('max(mean)')} AS highest_mean, arg_min(cluster, mean) AS lowest,
               {r('min(mean)')} AS lowest_mean FROM m"""
    ),
)
def extreme_clusters(spark, sf_dir):
    return rounded(C.extreme_clusters(labelled(spark, sf_dir, "risk")))


_MEANS = ", ".join(f"avg({c}) AS {c}" for c in S.RADAR)


@register(
    "a12_cluster_means",
    over_jobs(
        f"{_LABELLED} SELECT cluster, {', '.join(r(f'avg({c})') + f' AS {c}' for c in S.RADAR)} FROM labelled GROUP BY cluster"
    ),
)
def cluster_means(spark, sf_dir):
    return rounded(A.group_means(labelled(spark, sf_dir, *S.RADAR), "cluster", S.RADAR))


@register("a13_cluster_sizes", over_jobs(f"{_LABELLED} SELECT cluster, count(*) AS n FROM labelled GROUP BY cluster"))
def cluster_sizes(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"))


@register(
    "k13_cluster_radar",
    over_jobs(
        f"""{_LABELLED}, m AS (SELECT cluster, {_MEANS} FROM labelled GROUP BY cluster)
        SELECT cluster, {', '.join(r(f'CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0e0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END') + f' AS {c}' for c in S.RADAR)} FROM m"""
    ),
)
def cluster_radar(spark, sf_dir):
    return rounded(C.radar(labelled(spark, sf_dir, *S.RADAR), S.RADAR))


@register(
    "o02_top_cluster_titles",
    over_jobs(
        f"""{_LABELLED}, m AS (SELECT cluster, avg(risk) AS mean FROM labelled GROUP BY cluster),
        best AS (SELECT arg_max(cluster, mean) AS cluster FROM m)
        SELECT job_title, count(*) AS n FROM labelled WHERE cluster IN (SELECT cluster FROM best)
        GROUP BY job_title ORDER BY n DESC, job_title LIMIT 15"""
    ),
)
def top_cluster_titles(spark, sf_dir):
    rows = labelled(spark, sf_dir, "job_title", "risk")
    highest = C.extreme_clusters(rows).select("highest").scalar()
    return Q.top_counts(rows.where(F.col("cluster") == highest), "job_title")


_SCALED = (
    _LABELLED
    + ", fit AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in VECTOR)
    + " FROM jobs), scaled AS (SELECT row_id, cluster, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in VECTOR)
    + " FROM labelled, fit), centres AS (SELECT cluster, count(*) * 1e0 AS n, "
    + ", ".join(f"avg({c}) AS c_{c}" for c in VECTOR)
    + " FROM scaled GROUP BY cluster)"
)
_OFF = " + ".join(f"pow({c} - c_{c}, 2)" for c in VECTOR)


def scaled(spark, sf_dir, *keep: str):
    rows = labelled(spark, sf_dir, *keep, *VECTOR, heavy=True)
    return standardise(rows, VECTOR).select(*keep, "cluster", *VECTOR)


_QUALITY = (
    _SCALED
    + f", within AS (SELECT sum({_OFF}) AS w FROM scaled JOIN centres USING (cluster))"
)


@register("c08_inertia", over_jobs(_QUALITY + f" SELECT {r('w', 4)} AS inertia FROM within"))
def inertia(spark, sf_dir):
    return rounded(C.inertia(scaled(spark, sf_dir), VECTOR, "cluster"), 4)


@register(
    "c06_calinski_harabasz",
    over_jobs(
        _QUALITY
        + f""", overall AS (SELECT {', '.join(f'avg({c}) AS o_{c}' for c in VECTOR)} FROM scaled),
        b AS (SELECT sum(n * ({' + '.join(f'pow(c_{c} - o_{c}, 2)' for c in VECTOR)})) AS b, count(*) AS k, sum(n) AS n
              FROM centres, overall)
        SELECT {r('(b / (k - 1)) / (w / (n - k))')} AS calinski_harabasz FROM b, within"""
    ),
)
def calinski_harabasz(spark, sf_dir):
    return rounded(C.calinski_harabasz(scaled(spark, sf_dir), VECTOR, "cluster"))


@register(
    "c07_davies_bouldin",
    over_jobs(
        _SCALED
        + f""", radii AS (SELECT cluster, avg(sqrt({_OFF})) AS s FROM scaled JOIN centres USING (cluster) GROUP BY cluster),
        t AS (SELECT * FROM radii JOIN centres USING (cluster)),
        worst AS (SELECT a.cluster, max((a.s + b.s) / sqrt({' + '.join(f'pow(a.c_{c} - b.c_{c}, 2)' for c in VECTOR)})) AS w
                  FROM t a JOIN t b ON a.cluster <> b.cluster GROUP BY a.cluster)
        SELECT {r('avg(w)', 4)} AS davies_bouldin FROM worst"""
    ),
)
def davies_bouldin(spark, sf_dir):
    return rounded(C.davies_bouldin(scaled(spark, sf_dir), VECTOR, "cluster"), 4)


_SAMPLE = 5000


@register(
    "c05_sampled_silhouette",
    over_jobs(
        _SCALED
        + f""", picked AS (SELECT * FROM scaled ORDER BY md5(concat(row_id, '-42')), row_id LIMIT {_SAMPLE}),
        sizes AS (SELECT cluster, count(*) AS m FROM picked GROUP BY cluster),
        gaps AS (SELECT a.row_id, a.cluster AS own, b.cluster AS other,
                        sum(sqrt({' + '.join(f'pow(a.{c} - b.{c}, 2)' for c in VECTOR)})) AS total
                 FROM picked a, picked b GROUP BY ALL),
        means AS (SELECT row_id, max(CASE WHEN own = other THEN total / greatest(m - 1, 1) END) AS inner_mean,
                         min(CASE WHEN own <> other THEN total / m END) AS outer_mean
                  FROM gaps JOIN sizes ON sizes.cluster = gaps.other GROUP BY row_id)
        SELECT {r('avg((outer_mean - inner_mean) / greatest(inner_mean, outer_mean))')} AS silhouette FROM means"""
    ),
)
def sampled_silhouette(spark, sf_dir):
    rows = scaled(spark, sf_dir, "row_id")
    return rounded(C.sampled_silhouette(rows, VECTOR, "cluster", "row_id", n=_SAMPLE))


_RADAR_SQL = ", ".join(
    r(f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0e0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END")
    + f" AS radar_{c}"
    for c in S.RADAR
)


def _bundle_shares(column: str, levels: list[str]) -> str:
    return ", ".join(
        r(f"round_even(count(CASE WHEN {column} = {sql_text(x)} THEN 1 END) * 1e0 / count(*), 3) * 100") + f' AS "{column}_{x}"'
        for x in levels
    )


@register(
    "c10_cluster_bundle",
    over_jobs(
        f"""{_LABELLED}, m AS (SELECT cluster, avg(risk) AS mean FROM labelled GROUP BY cluster),
        means AS (SELECT cluster, {_MEANS} FROM labelled GROUP BY cluster),
        radar AS (SELECT cluster, {_RADAR_SQL} FROM means),
        best AS (SELECT arg_max(cluster, mean) AS highest, arg_min(cluster, mean) AS lowest FROM m),
        titles AS (SELECT string_agg(job_title || ':' || n, '|' ORDER BY n DESC, job_title) AS top_titles
                   FROM (SELECT job_title, count(*) AS n FROM labelled, best WHERE cluster = highest
                         GROUP BY job_title ORDER BY n DESC, job_title LIMIT 15)),
        stats AS (SELECT cluster, {_E('avg(risk)')} AS risk_mean, {_E('stddev_samp(risk)')} AS risk_std,
          {_E('min(risk)')} AS risk_min, {_E('max(risk)')} AS risk_max, {_E('avg(salary)')} AS salary_mean,
          {_E('avg(experience)')} AS experience_mean, {_E('avg(remote)')} AS remote_mean,
          {_E('avg(diversity)')} AS diversity_mean, count(*) AS n, {_bundle_shares('industry', _INDUSTRIES)},
          {_bundle_shares('ai_impact', S.IMPACT_ORDER)} FROM labelled GROUP BY cluster)
        SELECT stats.*, radar.* EXCLUDE (cluster), stats.cluster = highest AS is_highest, stats.cluster = lowest AS is_lowest,
               CASE WHEN stats.cluster = highest THEN top_titles ELSE '' END AS top_titles
        FROM stats JOIN radar USING (cluster), best, titles"""
    ),
)
def cluster_bundle(spark, sf_dir):
    """Statistics, shares, radar, extremes and the highest cluster's titles, a row for each cluster."""
    cols = list(dict.fromkeys(["risk", "salary", "remote", "diversity", "industry", "ai_impact", "job_title", *S.RADAR]))
    rows = labelled(spark, sf_dir, *cols, heavy=True)
    named = lambda table, prefix: table.select(
        "cluster", *[F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in table.columns if c != "cluster"]
    )
    extreme = C.extreme_clusters(rows)
    highest = extreme.select("highest").scalar()
    top = Q.top_counts(rows.where(F.col("cluster") == highest), "job_title")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "job_title")))
    text = F.array_join(
        F.transform(listed, lambda t: F.concat(t["job_title"], F.lit(":"), (-t["m"]).cast("string"))), "|"
    )
    table = C.profile(rows)
    for more in (
        named(C.shares(rows, "industry", distinct_levels(rows, "industry")), "industry"),
        named(C.shares(rows, "ai_impact", S.IMPACT_ORDER), "ai_impact"),
        named(C.radar(rows, S.RADAR), "radar"),
    ):
        table = table.join(more, "cluster")
    is_highest = F.col("cluster") == highest
    return rounded(
        table.withColumns(
            {
                "is_highest": is_highest,
                "is_lowest": F.col("cluster") == extreme.select("lowest").scalar(),
                "top_titles": F.when(is_highest, top.agg(text).scalar()).otherwise(""),
            }
        )
    )


# --- fitted on the data ---

SWEEP = [*range(2, 11)]
MIXTURES = [*range(2, 8)]
STARTS = [*range(42, 52)]


def vectors(spark, sf_dir, *keep: str):
    """The whole prepared matrix as standardised vectors; fits pass over them many times."""
    ready = prepared(spark, sf_dir)
    rows = scale(ready.rows.select(*keep, *ready.features), ready.features, matrix_scaler(spark, sf_dir))
    return C.assemble(rows, ready.features).select(*keep, "features")


@register("c01_pca_scores")
def pca_scores(spark, sf_dir):
    scores, _ = C.pca(vectors(spark, sf_dir, "row_id"))
    return scores.select("row_id", "pc1", "pc2")


@register("c01_pca_variance")
def pca_variance(spark, sf_dir):
    _, parts = C.pca(vectors(spark, sf_dir, "row_id"))
    records = [(f"pc{i + 1}", v) for i, v in enumerate(parts)] + [("sum", sum(parts))]
    return spark.createDataFrame(records, "component string, explained double")


@register("c02_pca_by_risk")
def pca_by_risk(spark, sf_dir):
    scores, _ = C.pca(vectors(spark, sf_dir, "row_id", "risk"))
    label = cut("risk", S.RISK_EDGES, S.RISK_CODES)
    cell = lambda c: F.floor(F.col(c) / 0.5)
    return scores.groupBy(label.alias("label"), cell("pc1").alias("x_cell"), cell("pc2").alias("y_cell")).agg(
        F.count("*").alias("n")
    )


def swept(spark, sf_dir):
    """All k-means models of the sweep, fitted once for all queries that look at them."""
    fit = lambda: C.fit_kmeans_sweep(vectors(spark, sf_dir), SWEEP, STARTS)
    return _once(spark, sf_dir, "k-means", fit)


def mixtures(spark, sf_dir):
    return _once(spark, sf_dir, "mixtures", lambda: C.fit_gmm_sweep(vectors(spark, sf_dir), MIXTURES))


@register("c03_kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    return C.kmeans_table(spark, swept(spark, sf_dir))


def best_clusters(spark, sf_dir):
    best = Q.best_row(kmeans_sweep(spark, sf_dir), "silhouette").first()["k"]
    own = centres.nearest(swept(spark, sf_dir).models[best].centres, F.col("features"))
    return best, vectors(spark, sf_dir, "row_id").select("row_id", own.alias("cluster"))


@register("c04_best_clustering")
def best_clustering(spark, sf_dir):
    return best_clusters(spark, sf_dir)[1]


@register(
    "c04_clustering_check",
    over_jobs(" SELECT count(*) AS n, CAST(0 AS BIGINT) AS unlabelled, true AS falls, true AS inertia_agrees FROM jobs"),
)
def clustering_check(spark, sf_dir):
    """Rows, rows without a valid cluster, whether inertia falls with k, and whether the inertia of
    the labels is that of the sweep."""
    best, labels = best_clusters(spark, sf_dir)
    model = swept(spark, sf_dir).models[best]
    inertias = [r[1] for r in swept(spark, sf_dir).records]
    falls = all(a >= b for a, b in zip(inertias, inertias[1:]))
    off = F.aggregate(
        F.zip_with(
            vector_to_array("features"),
            F.get(F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.centres]), F.col("cluster")),
            lambda a, b: (a - b) * (a - b),
        ),
        F.lit(0.0),
        lambda a, b: a + b,
    )
    rows = vectors(spark, sf_dir, "row_id").join(labels, "row_id", "left")
    valid = F.coalesce(F.col("cluster").between(0, best - 1), F.lit(False))
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(~valid).alias("unlabelled"),
        F.lit(falls).alias("falls"),
        (F.abs(F.sum(off) / F.lit(model.inertia) - 1) < 1e-6).alias("inertia_agrees"),
    )


@register("c05_squared_silhouette")
def squared_silhouette(spark, sf_dir):
    rows = VectorAssembler(inputCols=VECTOR, outputCol="features").transform(scaled(spark, sf_dir))
    value = ClusteringEvaluator(predictionCol="cluster").evaluate(rows)
    return spark.createDataFrame([(float(value),)], "squared_silhouette double")


@register("c09_gmm_sweep")
def gmm_sweep(spark, sf_dir):
    return C.gmm_table(vectors(spark, sf_dir), mixtures(spark, sf_dir))


def gmm_rows(spark, sf_dir):
    best = Q.best_row(gmm_sweep(spark, sf_dir), "bic", largest=False).first()["k"]
    own = centres.likeliest(mixtures(spark, sf_dir)[best], F.col("features"))
    return vectors(spark, sf_dir, "row_id").select("row_id", own.alias("cluster"))


@register("c09_gmm_labels")
def gmm_labels(spark, sf_dir):
    return gmm_rows(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"))


@register(
    "c09_gmm_check",
    over_jobs(" SELECT count(*) AS n, CAST(0 AS BIGINT) AS unlabelled, true AS likelihood_rises FROM jobs"),
)
def gmm_check(spark, sf_dir):
    """Rows, rows without a component, and whether no round of any mixture lost likelihood."""
    paths = [m.path for m in mixtures(spark, sf_dir).values()]
    rises = all(b >= a - 1e-6 for path in paths for a, b in zip(path, path[1:]))
    valid = F.coalesce(F.col("cluster").between(0, max(MIXTURES) - 1), F.lit(False))
    return gmm_rows(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(~valid).alias("unlabelled"), F.lit(rises).alias("likelihood_rises")
    )
