"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local one is set only in local mode, where one machine holds all tasks;
    a cluster without the setting is refused, as its executors could not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="emberline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def persisted(df: DataFrame, name: str, block_bytes: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing.
    block_bytes: size of a row group, for tables of few large rows, which are read a row group at a time."""
    path = new_path(df.sparkSession, name)
    write = df.write.option("compression", "zstd")
    (write.option("parquet.block.size", block_bytes) if block_bytes else write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, block_bytes: int | None = None) -> DataFrame:
    """The same, dealt into files by the hash of key: what is grouped or joined by it later is not shuffled again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    view = path.rsplit("/", 1)[-1].replace("-", "_")
    write = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key)
    (write.option("parquet.block.size", block_bytes) if block_bytes else write).saveAsTable(view)
    return spark.table(view)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
