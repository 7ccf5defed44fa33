"""Named local data sets, and files compressed without saying so."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrank.sources import edge_list, matrix_market


class Catalog:
    """Names of matrices and graphs with their paths; nothing is downloaded."""

    def __init__(self, entries: dict[str, tuple[str, str]] | None = None):
        self.entries = dict(entries or {})

    def add(self, name: str, path: str, kind: str = "matrix_market") -> None:
        if kind not in ("matrix_market", "edge_list"):
            raise ValueError(f"unknown kind {kind}")
        self.entries[name] = (path, kind)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        path, kind = self.entries[name]
        if kind == "matrix_market":
            return matrix_market.read(spark, path)
        return edge_list.compact(edge_list.read_edges(spark, path), directed=edge_list.header(spark, path).directed)[0]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, p, kind) for k, (p, kind) in sorted(self.entries.items())], "name string, path string, kind string")


def is_gzip(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, gzip) of each file, by the first two bytes; shorter files are an error."""
    files = spark.read.format("binaryFile").load(path)
    short = F.raise_error(F.concat(F.lit("fewer than two bytes: "), F.col("path"))).cast("boolean")
    return files.select("path", "length", F.when(F.col("length") < 2, short).otherwise(F.substring("content", 1, 2) == F.lit(bytearray(b"\x1f\x8b"))).alias("gzip"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, compressed by gzip or not, whatever its name."""
    import gzip

    local = path.removeprefix("file://")
    if Path(local).is_file() and not local.endswith(".gz") and is_gzip(spark, path).first()["gzip"]:
        def unpack(batches):
            import pyarrow as pa

            for batch in batches:
                for content in batch.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array(gzip.decompress(content.as_py()).decode().splitlines())], ["value"])

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "value string")
    return spark.read.text(path)
