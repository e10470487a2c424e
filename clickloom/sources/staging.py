"""Written intermediate tables in the cluster's shared folder.

A frame that several later steps read is written once as Parquet and read back: lineage is
cut, columns are pruned on the way back in, and a lost executor costs a re-read, not a
recomputation. The folder is the one named in `spark.checkpoint.dir`.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="clickloom-"))
    return context.getCheckpointDir().rstrip("/")


class Staging:
    """Intermediate tables of one job. Use as a context manager where the job ends by
    writing its result; a query that returns a lazy frame leaves its tables to the shared
    folder's own retention, because the frame still reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/clickloom/{uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, frame: DataFrame, name: str) -> DataFrame:
        path = self.path(f"{name}-{uuid4().hex[:8]}")
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def clear(self) -> None:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.clear()
