"""Parquet tables of a scale folder, and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder;
    on a cluster each executor would write to a disk of its own, so that is an error."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.spoolworks.shared.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spoolworks-')}"
        spark.conf.set("spark.spoolworks.shared.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` computed once, kept as a Parquet table in the shared folder, and read from there.

    Lineage ends at that table, so a lost executor costs a reread and no recomputation. The table stays; `Scratch`
    can remove its tables.
    """
    return Scratch(df.sparkSession).written(df, name)


class Scratch:
    """Written tables of one computation, by name. `remove` those that neither a later step nor the result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def remove(self, *names: str) -> None:
        java = self.spark.sparkContext._jvm
        for name in names:
            path = java.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
