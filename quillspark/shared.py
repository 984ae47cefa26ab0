"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local one on a single machine, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores: a small table in fewer parts than there are cores is shuffled once before costly work on its rows.

    By ``keys``, if given, which saves the shuffle of a grouping by them that follows; they have to be near unique. Fewer parts than cores hold at most a file block for each core; larger tables are left as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, *keys) if parts < cores else df


class Scratch:
    """Tables written once and read many times, so that no step is computed twice and lost executors cost nothing.

    ``save`` returns the table as read back from the shared folder; ``drop`` deletes a table that no
    later step reads. What the result itself reads is deleted when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_folder(spark)}/quillspark-{uuid.uuid4().hex}"
        files, path = self._files(self.at)
        files.deleteOnExit(path)

    def _files(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.at}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # keeps the name beside the frame
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            files, path = self._files(df._scratch_path)
            files.delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the Python workers, once for each Spark context, so that they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._quillspark_shipped = True
