"""Stage tables that lie bucketed and sorted by their key, so that joins and groupings on it need no shuffle.

The rows move once, when a table is written; every later one-to-one join reads bucket by bucket. Beside its rows a
table keeps an empty one with its columns and, in the metadata of the key, the number of buckets: so any session
can declare it again, also where it has no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from reqlens.sources.tables import require_columns, require_inputs

BUCKETS = 256  # of a table, unless said otherwise: a bucket should fit in a task's memory when sorted
HAS_KEY, BUCKET_COUNT, LAYOUT = "_has_key", "bucket_count", "_layout"


def _name(path: str) -> str:
    return f"reqlens_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_bucketed(df: DataFrame, path: str, key: str = "unique_key", buckets: int = BUCKETS) -> str:
    """Write ``df`` in ``buckets`` sorted files by ``key``.

    Rows without a key would share one bucket. They go to a folder of their own and are dealt by all their
    columns, however many they are: ``hash`` skips nulls, so the second expression moves only them.
    """
    require_columns(df, [key], "table")
    if HAS_KEY in df.columns:
        raise ValueError(f"{HAS_KEY} is taken")
    spread = F.when(F.col(key).isNull(), F.xxhash64(*[F.col(_quoted(name)) for name in df.columns]))
    df = df.withMetadata(key, {BUCKET_COUNT: buckets})
    marked = df.withColumn(HAS_KEY, F.col(key).isNotNull().cast("int"))
    name = _name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (marked.repartition(buckets, F.col(key), spread)
     .write.mode("overwrite").option("compression", "zstd").option("path", path)
     .partitionBy(HAS_KEY).bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    df.sparkSession.createDataFrame([], df.schema).write.parquet(f"{path}/{LAYOUT}")
    return path


def _declared(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` with its buckets, declared anew: another session may have written it."""
    require_inputs(spark, [f"{path}/{LAYOUT}"])
    schema = spark.read.parquet(f"{path}/{LAYOUT}").schema
    keys = [field for field in schema if BUCKET_COUNT in field.metadata]
    key, buckets, name = _quoted(keys[0].name), int(keys[0].metadata[BUCKET_COUNT]), _name(path)
    columns = ", ".join(f"{_quoted(field.name)} {field.dataType.simpleString()}" for field in schema)
    columns += f", {HAS_KEY} int"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({HAS_KEY}) "
              f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def read_bucketed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, which later plans read bucket by bucket where that saves a shuffle; and rows without one."""
    table = _declared(spark, path)
    return tuple(table.where(F.col(HAS_KEY) == side).drop(HAS_KEY) for side in (1, 0))
