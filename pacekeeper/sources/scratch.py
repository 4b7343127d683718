"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read; a temporary one only where the session names none and its master is local."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pacekeeper-")
        _own.append((spark, found))
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder; an executor lost later costs no recomputation. They go when the program ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pacekeeper-{name}-{uuid.uuid4().hex}"
        _own.append((spark, self.root))

    def keep(self, df: DataFrame, name: str, *parts: str) -> DataFrame:
        """``df`` as written; the columns ``parts``, which come last in it, become folders, so that a filter on them reads no other rows."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").partitionBy(*parts).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no live frame reads any more."""
        delete(self.spark, f"{self.root}/{name}")


def keep(df: DataFrame, name: str) -> DataFrame:
    return Scratch(df.sparkSession, name).keep(df, name)


@atexit.register
def _sweep() -> None:
    for spark, path in reversed(_own):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
