"""Helpers shared by the corpus operators: scratch tables in the folder all executors see."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="reqlens-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written between steps of one call; ``drop`` removes those that later tables have replaced."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:02d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back: later steps survive lost executors and see pruned scans."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def identified_texts(documents: DataFrame) -> DataFrame:
    """Only the id and the text (null as empty): other columns cannot clash with those an operator adds."""
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids give null."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % divisor


def per_task(spark: SparkSession) -> int:
    """Partitions for a shuffle of whole texts: as the session says."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application: they may lack the driver's module path."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="reqlens-code-")) / "reqlens.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
