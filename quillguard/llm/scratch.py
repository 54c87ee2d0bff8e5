"""Tables written in the folder that all executors share, to cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..cluster import ship

#: Used only in local mode, where the session names no shared folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints"
#: Lets the shuffle files of a written table go once it is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, local mode sets one of its own; a cluster
    has no folder that could be guessed, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_DIR
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch to or from Python, where the session sets none: texts differ too much in length for a count of rows.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def prepare(spark: SparkSession) -> None:
    """Make the session ready for Python workers."""
    ship(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


class Scratch:
    """Parquet tables of one operator call. They go when the application ends, or earlier by drop()."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path, fs = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def scheme(self, path: str) -> str:
        """The scheme of the store that a path is in; file for folders that machines mount."""
        return self._at(path)[1].getUri().getScheme() or "file"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table, read again."""
        conf = self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        finally:
            conf.set(CLEANUP, before)
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._at(self.path(name))
            fs.delete(path, True)
