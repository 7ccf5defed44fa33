"""Sessions, and tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridrank")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a local one is set if all executors are on this machine; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridrank-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Kept:
    """A table written to the shared folder, so that lineage ends there; drop() deletes it.

    With `by`, it is kept in as many buckets as shuffles have partitions, so that joins on that column needn't move it.
    """

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        self.spark, self.path, self.table = df.sparkSession, new_path(df.sparkSession, name), None
        if by:
            self.table = self.path.rsplit("/", 1)[1].replace("-", "_")
            df.write.bucketBy(buckets(self.spark), by).option("path", self.path).saveAsTable(self.table)
            self.df = self.spark.table(self.table)
        else:
            df.write.parquet(self.path)
            self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if self.table:
            self.spark.sql(f"DROP TABLE {self.table}")
        delete(self.spark, self.path)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
