"""Matrices and vectors as views of the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts are numbered from 0 without gaps."""
    return table(spark, sf_dir, "part").count()


def part_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a part follows another within an order; a square matrix."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), F.lead("l_partkey").over(w).alias("j"))
    return steps.where("j is not null").groupBy("i", "j").agg(F.count("*").cast("double").alias("v"))


def part_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of it above the diagonal: some nodes have no way out, some none in."""
    return part_next(spark, sf_dir).where("i < j")


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by order and part, rectangular, with repeated cells."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the customer's and the supplier's nation; at most 25 x 25. Customers and suppliers are joined before counting; both joins are on unique keys."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("i"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("j"))
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return both.groupBy("i", "j").agg(F.count("*").cast("double").alias("v"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding table as a dense matrix."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("bigint"), F.col("v").cast("double"))


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector over parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x"))


def order_ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector over orders, from 1 to 5."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("x"))


_STEPS = "SELECT l_partkey AS i, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS j FROM lineitem"
#: The same views for the oracle.
SQL = {
    "nxt": f"SELECT i, j, CAST(count(*) AS DOUBLE) AS v FROM ({_STEPS}) WHERE j IS NOT NULL GROUP BY i, j",
    "dag": f"SELECT i, j, CAST(count(*) AS DOUBLE) AS v FROM ({_STEPS}) WHERE j IS NOT NULL AND i < j GROUP BY i, j",
    "op": "SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem",
    "trade": "SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "emb": "SELECT vec_id AS i, CAST(p - 1 AS BIGINT) AS j, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS t(p)",
    "sizes": "SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS x FROM part",
    "ones": "SELECT o_orderkey AS i, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS x FROM orders",
    "nn": "SELECT CAST(count(*) AS BIGINT) AS n FROM part",
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{k} AS ({SQL[k]})" for k in names) + " " + sql
