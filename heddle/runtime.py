"""Session helpers shared by all operators: shared scratch folders, shipping the package, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all
    run on one machine (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="heddle-shared-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


class Scratch:
    """Tables written under the shared folder to cut lineage, so that a lost executor costs a reread, not a rerun."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name))
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows and bytes of a batch handed to Python at once, where the session sets none itself; texts can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it installed (once per application), and keep the
    batches they get small."""
    sc = spark.sparkContext
    for key, ours in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, ours)
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="heddle-ship-"), "heddle.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("heddle", os.path.relpath(full, here)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; paths are only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
