"""Edge lists with commented headers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrank.schema import GraphInfo


def header(spark: SparkSession, path: str, most_lines: int = 1000) -> GraphInfo:
    """Nodes, edges and direction from the comments; a graph that names no direction is directed."""
    lines = [r["value"] for r in spark.read.text(path).where(F.col("value").startswith("#")).limit(most_lines).collect()]
    text = "\n".join(lines)
    size, kind = re.search(r"#\s+Nodes:\s*(\d+)\s+Edges:\s*(\d+)", text), re.search(r"#\s*(Undirected|Directed)\s+graph", text)
    if not size:
        raise ValueError(f"{path} names no numbers of nodes and edges")
    return GraphInfo(int(size[1]), int(size[2]), not kind or kind[1] == "Directed")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of all lines that are no comments."""
    token = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(token[0].cast("bigint").alias("src"), token[1].cast("bigint").alias("dst"))


def compact(edges: DataFrame, *, directed: bool = True) -> tuple[DataFrame, DataFrame]:
    """The adjacency matrix over ids 0..k-1 in the order of the old ids, and (node, k). Repeated edges add up.

    Ids are numbered by ranges: each range counts its own, and the counts of ranges, few, are added up in one place.
    """
    from gridrank.operators.reorder import numbered

    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    ids = numbered(nodes, ["node"], "k")
    found = edges.join(ids.select(F.col("node").alias("src"), F.col("k").alias("i")), "src").join(ids.select(F.col("node").alias("dst"), F.col("k").alias("j")), "dst").select("i", "j")
    if not directed:
        found = found.unionByName(found.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j")))
    return found.groupBy("i", "j").agg(F.count("*").cast("double").alias("v")), ids


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """1-based cells (i, j, 1.0) of a plain list of pairs; lines that begin with // or % are skipped."""
    token = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("//") & ~F.trim("value").startswith("%"))
    return lines.select(token[0].cast("bigint").alias("i"), token[1].cast("bigint").alias("j"), F.lit(1.0).alias("v"))
