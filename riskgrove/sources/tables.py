"""The analysis table over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The analysis table in SQL; it runs unchanged in Spark and in other engines.
JOBS_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(l_quantity AS INT), CAST(l_shipdate AS DATE)) AS row_id,
       CAST(l_partkey AS VARCHAR(20))       AS job_title,
       p_type                               AS industry,
       CASE l_linestatus WHEN 'O' THEN 'Increasing' ELSE 'Decreasing' END AS job_status,
       CASE l_returnflag WHEN 'N' THEN 'Low' WHEN 'A' THEN 'Moderate' ELSE 'High' END AS ai_impact,
       l_extendedprice * 1.4E0              AS salary,
       CASE o_orderpriority WHEN '5-LOW' THEN 'High School'
            WHEN '4-NOT SPECIFIED' THEN 'Associate Degree' WHEN '3-MEDIUM' THEN 'Bachelor’s Degree'
            WHEN '2-HIGH' THEN 'Master’s Degree' ELSE 'PhD' END AS education,
       CAST(l_suppkey % 25 AS INT)          AS experience,
       p_size                               AS openings_now,
       CAST(l_quantity AS INT)              AS openings_future,
       l_discount * 1000E0                  AS remote,
       o_totalprice / 5000E0                AS risk,
       r_name                               AS location,
       l_tax * 1000E0                       AS diversity
FROM lineitem
JOIN orders   ON l_orderkey  = o_orderkey
JOIN part     ON l_partkey   = p_partkey
JOIN customer ON o_custkey   = c_custkey
JOIN nation   ON c_nationkey = n_nationkey
JOIN region   ON n_regionkey = r_regionkey
"""

# Per analysis column: its expression, and the dimension it needs beside lineitem.
_COLUMNS = {
    "row_id": (
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        "CAST(l_quantity AS INT), CAST(l_shipdate AS DATE))",
        None,
    ),
    "job_title": ("CAST(l_partkey AS STRING)", None),
    "industry": ("p_type", "part"),
    "job_status": ("CASE l_linestatus WHEN 'O' THEN 'Increasing' ELSE 'Decreasing' END", None),
    "ai_impact": (
        "CASE l_returnflag WHEN 'N' THEN 'Low' WHEN 'A' THEN 'Moderate' ELSE 'High' END",
        None,
    ),
    "salary": ("l_extendedprice * 1.4E0", None),
    "education": (
        "CASE o_orderpriority WHEN '5-LOW' THEN 'High School' "
        "WHEN '4-NOT SPECIFIED' THEN 'Associate Degree' WHEN '3-MEDIUM' THEN 'Bachelor’s Degree' "
        "WHEN '2-HIGH' THEN 'Master’s Degree' ELSE 'PhD' END",
        "orders",
    ),
    "experience": ("CAST(l_suppkey % 25 AS INT)", None),
    "openings_now": ("p_size", "part"),
    "openings_future": ("CAST(l_quantity AS INT)", None),
    "remote": ("l_discount * 1000E0", None),
    "risk": ("o_totalprice / 5000E0", "orders"),
    "location": ("r_name", "region"),
    "diversity": ("l_tax * 1000E0", None),
}
JOBS_COLUMNS = list(_COLUMNS)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when the files of a scan make fewer splits than there are cores.

    Input of more splits than cores, as any large table has, is left alone.
    """
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted, *keys) if rows.rdd.getNumPartitions() < wanted else rows


def jobs(spark: SparkSession, sf_dir: str, *columns: str, heavy: bool = False) -> DataFrame:
    """The analysis table, joining only the dimensions the asked columns come from.

    Each lineitem row has exactly one order, part, customer, nation and region (see
    ``broken_references``), so a join whose columns nobody reads changes nothing and
    is left out. Join strategies are left to Spark: it broadcasts a dimension only
    when its size is known to be small, and splits skewed keys otherwise. ``heavy`` says
    that the work per row is worth spreading a scan of few splits over all cores.
    """
    names = list(columns) or JOBS_COLUMNS
    needs = {_COLUMNS[name][1] for name in names}
    rows = load(spark, sf_dir, "lineitem")
    if heavy:
        rows = spread(rows, "l_orderkey", "l_linenumber")
    if needs & {"orders", "region"}:
        orders = load(spark, sf_dir, "orders")
        if "region" in needs:
            places = load(spark, sf_dir, "nation").join(
                load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
            )
            buyers = load(spark, sf_dir, "customer").join(
                places, F.col("c_nationkey") == F.col("n_nationkey")
            )
            orders = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in needs:
        rows = rows.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*[F.expr(_COLUMNS[name][0]).alias(name) for name in names])


def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a parent and doubled parents per reference; all zero for sound input."""
    links = [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("nation", "n_regionkey", "region", "r_regionkey"),
    ]
    out = None
    for child, fk, parent, pk in links:
        parents = load(spark, sf_dir, parent).groupBy(F.col(pk).alias("k")).agg(
            F.count("*").alias("copies")
        )
        children = load(spark, sf_dir, child).groupBy(F.col(fk).alias("k")).agg(
            F.count("*").alias("n")
        )
        part = children.join(parents, "k", "full").agg(
            F.lit(f"{child}.{fk}").alias("reference"),
            F.coalesce(F.sum(F.when(F.col("copies").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
            F.count_if(F.col("copies") > 1).alias("doubled"),
        )
        out = part if out is None else out.unionByName(part)
    return out
